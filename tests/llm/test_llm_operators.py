"""The training-data operators against brute force, and on nulls, empty texts, repeated rows, clashing columns and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evigrain.llm import covertree, linedup, media, mixing, ngrams, pieces, quality, queries, sanitise, secrets, simhash, staging

DATA = "/root/testdata/sf0.001"
ODD = [(9001, None, None, None), (9002, "", "en", "src0"), (9003, "one", None, "src1"), (9003, "one", None, "src1"), (9004, "a b c " * 3000, "en", "src0"), (9005, "x" * 20000, "en", None)]


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents, odd ones, and columns whose names operators use themselves."""
    real = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    both = real.unionByName(spark.createDataFrame(ODD, real.schema)).repartition(3)
    return both.withColumns({"id": F.lit(1), "key": F.lit("k"), "size": F.lit(2), "fp": F.lit(3), "kept": F.lit(False), "found": F.lit("f")}).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def components(ids, linked):
    comp = np.array(ids)
    while True:
        new = np.where(linked, comp[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == comp).all():
            return comp
        comp = new


@pytest.mark.parametrize(("width", "most"), [(3, 3), (5, 14)])
def test_simhash(spark, docs, texts, width, most):
    def fingerprint(text):
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) > width else [b" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    got = simhash.simhash_groups(docs, width=width, max_distance=most).toPandas()
    want = dict((i, fingerprint(t)) for i, t in texts)
    assert len(got) == len(texts) and all(r.fingerprint == f"{want[r.doc_id]:016x}" for r in got.itertuples())
    fps = np.array([want[i] for i in got.doc_id], np.uint64)
    linked = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= most
    if most > simhash.HALVES_UP_TO:
        second = {r.id: r.second for r in simhash.fingerprints(docs, "doc_id", "text", width).collect()}
        others = np.array([second[i] for i in got.doc_id], np.int64).view(np.uint64)
        linked &= np.bitwise_count(others[:, None] ^ others[None, :]) <= most
    assert (components(got.doc_id, linked) == got.component_id).all()
    assert simhash.simhash_groups(empty(spark)).count() == 0


def test_vantage_trees_find_all_pairs():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = fps[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    fps = np.concatenate([fps, near])
    for side in (0, 1):
        values = (fps >> np.uint64(32 * side)).astype(np.uint32)
        met = set()
        for _, rows, home in simhash.route(simhash.fit_tree(values[:100], 5), values, 1):
            met |= {frozenset((int(a), int(b))) for a in rows[home] for b in rows}
        close = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 1)
        assert all(frozenset((int(a), int(b))) in met for a, b in close)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(100, 101), (101, 100), (7, 7)]])
def test_connected_components(spark, edges):
    got = {r.node: r.root for r in staging.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {}
    for a, b in edges:
        group = {x for x in want if want[x] in (want.get(a, a), want.get(b, b))} | {a, b}
        low = min(group | {want.get(a, a), want.get(b, b)})
        want |= dict.fromkeys(group, low)
    assert got == {k: v for k, v in want.items() if k != v}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def entities(text):
    def good(kind, value):
        digits = [int(c) for c in value if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if good(k, m[0])]


def test_personal_data(spark):
    random.seed(3)
    parts = ["a", "b@c.de", "@", ".", "0", "1", "22", "10.0.0.1", "255", "256", "4111111111111111", " ", "-", "+1", "(", "é", "😀", "4012888888881881", "001.2.3.4", "+", "\n"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 30)))) for i in range(600)]
    rows += [(None, "x@y.zz"), (700, None), (701, ""), (702, "1" * 5000), (703, "x@y.zz again"), (703, "x@y.zz again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    got = sanitise.span_digests(sanitise.find_personal_data(df)).collect()
    assert len(got) == len(rows)
    want = collections.Counter((i, hashlib.sha256(",".join(entities(t or "")).encode()).hexdigest()) for i, t in rows)
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == want
    assert sanitise.find_personal_data(empty(spark)).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"the zorvex of {'mail ann@ex.org' if i < 6 else 'nothing'} the rest number {i} of the page") for i in range(6)]
    rows += [(10 + i, "the rest of the page holds nothing of note and the number of words is large " * 3) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sanitise.find_personal_data(df)
    words = {r.doc_id: {dict(rows)[r.doc_id][t.start : t.end]: t.action for t in r.term} for r in found.collect()}
    assert all(words[i].get("zorvex") == "remove" and "the" not in words[i] for i in range(6)) and not any(words[i] for i in range(10, 40))
    clean = {r.doc_id: r.text for r in sanitise.sanitised_texts(df, found).collect()}
    assert "ann@" not in clean[0] and "[EMAIL]" in clean[0] and "zorvex" not in clean[0] and clean[10] == dict(rows)[10]


def test_disclosure_scores_and_places_against_brute_force(spark):
    """Counts, scores and places of the terms, by plain loops over small texts."""
    random.seed(11)
    words = [f"word{c}" for c in "abcdefgh"]
    people = ["ann@ex.org", "+1 (017) 555-7713", "10.0.0.1"]
    rows = []
    for i in range(80):
        parts = [random.choice(words) for _ in range(random.randint(5, 60))]
        if i % 4 < 3:
            parts.insert(random.randrange(len(parts)), f"zeta{i % 4} {people[i % 4]} omega{i % 4 if random.random() < 0.8 else ''}")
            parts.append(f"zeta{i % 4}")
        rows.append((i, " ".join(parts)))
    term = re.compile(r"[^\W\d_][\w'-]{2,}")
    hidden, spans = {}, {}
    for i, text in rows:
        spans[i] = [(int(a), int(b), k) for k, a, b in (e.split(":") for e in entities(text))]
        for a, b, _ in spans[i]:
            text = text[:a] + "\n" * (b - a) + text[b:]
        hidden[i] = text
    n_t, near = collections.Counter(), set()
    for i, text in rows:
        n_t.update(m[0].lower() for m in term.finditer(hidden[i]))
        for a, b, kind in spans[i]:
            low, high = max(0, a - sanitise.WINDOW - 1), b + sanitise.WINDOW + 1
            for lo, hi in ((low, a), (b, min(high, len(text)))):
                for m in term.finditer(hidden[i][lo:hi]):
                    cut = (m.start() == 0 and lo > 0) if hi == a else (m.end() > sanitise.WINDOW and hi == high)
                    if not cut:
                        near.add((i, f"{kind}:{text[a:b].lower()}", m[0].lower(), lo + m.start()))
    n_te, n_e = collections.Counter((t, e) for _, e, t, _ in near), collections.Counter(e for _, e, _, _ in near)
    docs = collections.Counter((t, e) for t, e, _ in {(t, e, i) for i, e, t, _ in near})
    every, want = sum(n_t.values()), collections.defaultdict(dict)
    for i, e, t, _ in near:
        p = n_e[e] / (every + 1)
        score = math.log2(min(1, n_te[t, e] / n_t[t]) / p) / -math.log2(p)
        if docs[t, e] >= 2 and score >= sanitise.GENERALISE_AT:
            act = "remove" if score >= sanitise.REMOVE_AT else "generalise"
            want[i][t] = max(act, want[i].get(t, ""))
    assert any(want.values())
    got = sanitise.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        places = sorted((m.start(), m.end(), want[r.doc_id][m[0].lower()]) for m in term.finditer(hidden[r.doc_id]) if m[0].lower() in want[r.doc_id])
        assert [tuple(t) for t in r.term] == places


def test_a_text_with_many_entities(spark):
    long = " ".join(f"person number {i} has mail{i}@site{i % 50}.example.org or 10.1.{i // 250}.{i % 250}" for i in range(10_000))
    got = sanitise.span_digests(sanitise.find_personal_data(spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string"))).collect()
    one = next(r for r in got if r.doc_id == 1)
    assert (one.n_email, one.n_ip) == (10_000, 10_000) and one.base_sha256 == hashlib.sha256(",".join(entities(long)).encode()).hexdigest()


def targets_of(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights, total = {s: 1 + i % 3 for i, s in enumerate(order)}, sum(sizes.values())
    capped, target = set(), {}
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weights[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weights[s] / free for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s] + 1e-9} - capped
        if not over:
            return target
        capped |= over


def test_mix(spark, docs):
    got = mixing.mix_sources(docs).toPandas()
    again = mixing.mix_sources(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))
    rows = docs.select("text", "source").collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = targets_of(sizes)
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    for source, group in got.groupby(got.source.fillna("null")):
        name = None if source == "null" else source
        assert group.source_size.iloc[0] == sizes[name] and group.target.iloc[0] == pytest.approx(want[name]) and abs(group.taken.sum() - want[name]) <= 6
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_mix_where_sources_are_capped(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(5, "a"), (500, "b"), (0, "c"), (3, "d"), (100, None)])]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=7).collect()
    want = targets_of({"a": 5, "b": 500, "c": 0, "d": 3, None: 100})
    assert all(r.target == pytest.approx(want[r.source]) and abs(r.taken - r.target) <= 4 for r in got)


def test_the_sequence_decides_what_is_taken(spark, docs):
    """By a plain loop over the slots, and with another sequence."""

    def plain(sizes, step):
        order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        quota = {s: round(t) for s, t in targets_of(sizes).items()}
        total, low, got = sum(quota.values()), 0, collections.Counter()
        spans = []
        for s in order:
            spans.append((low / total, (low + quota[s]) / total, s))
            low += quota[s]
        for n in range(-(-total // mixing.block_length(total))):
            point = n * step - math.floor(n * step)
            got[next(s for a, b, s in spans if a <= point < b)] += 1
        return got

    sizes = collections.Counter()
    for r in docs.select("text", "source").collect():
        sizes[r.source] += len((r.text or "").encode().split())
    results = []
    for step in (mixing.GOLDEN, 0.5, 0.0):
        got = mixing.mix_sources(docs, step=step).collect()
        want = plain(sizes, step)
        assert all(r.n_slots == want[r.source] for r in got)
        results.append(sorted((r.doc_id, r.taken) for r in got))
        taken = collections.Counter()
        for r in got:
            taken[r.source] += r.taken
        words = mixing.block_length(sum(round(t) for t in targets_of(sizes).values()))
        assert all(taken[s] == min(3 * sizes[s], want[s] * words) for s in sizes)
        assert all((r.first_slot is None) == (r.taken == 0) for r in got)
    assert results[0] != results[1] != results[2]


def lines_within_one_word(rows):
    lines = sorted((d, i, tuple(x.encode().lower().split())) for d, t in rows if t is not None and d is not None for i, x in enumerate(t.split("\n")))
    lines = [x for x in lines if len(x[2]) >= linedup.MIN_WORDS]

    def distance(a, b):
        if a == b:
            return 0
        if len(a) == len(b):
            return 1 if sum(x != y for x, y in zip(a, b, strict=True)) == 1 else None
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return 1 if len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long))) else None

    out = {}
    for j, (d, i, words) in enumerate(lines):
        found = [x for x in (distance(words, e[2]) for e in lines[:j]) if x is not None]
        if found:
            out[d, i] = min(found)
    return out, {(d, i): w for d, i, w in lines}, distance


@pytest.mark.parametrize("parts", [1, 5])
def test_lines(spark, parts):
    random.seed(5)
    base = [[random.choice("abcdefgh") for _ in range(random.choice([4, 5, 6, 9, 17, 20, 33]))] for _ in range(12)]
    rows = [(None, "a b c d e f"), (500, None), (501, "")]
    for k in range(120):
        text = []
        for _ in range(random.randint(0, 5)):
            words = list(random.choice(base))
            for _ in range(random.choice([0, 0, 1, 1, 2])):
                place, way = random.randrange(len(words)), random.random()
                words[place : place + (way < 0.7)] = [] if 0.4 <= way < 0.7 else [random.choice("abxyz")]
            text.append(" ".join(words))
        rows.append((k - 50, "\n".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).repartition(parts)
    removed = linedup.removed_lines(df)
    got = {(r.doc_id, r.line_no): r for r in removed.collect()}
    want, words, distance = lines_within_one_word(rows)
    assert set(got) == set(want)
    assert all((r.keeper_doc_id, r.keeper_line_no) < k and distance(words[k], words[r.keeper_doc_id, r.keeper_line_no]) == r.distance for k, r in got.items())
    left = {r.doc_id: r.text for r in linedup.drop_lines(df, removed).collect()}
    for doc, text in rows:
        kept = [x for i, x in enumerate((text or "").split("\n")) if (doc, i) not in want]
        if any((doc, i) in want for i in range(9)) and not any(len(x.split()) >= 5 for x in kept):
            assert doc not in left
        else:
            assert (left[doc] or "") == "\n".join(kept)
    assert linedup.removed_lines(empty(spark)).count() == 0


def test_media(spark, docs, texts):
    got = media.media_columns(docs).toPandas()
    want = collections.Counter()
    for i, text in texts:
        data = text.encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        want[i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    rows = got[["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]].itertuples(index=False)
    assert collections.Counter(map(tuple, rows)) == want
    assert got.groupby(["payload_sha256", "n_bytes"])[["media_sha256", "media_bytes", "feature"]].nunique().max().max() == 1
    stored = {hashlib.sha256(m).hexdigest(): len(m) for m in (media.encode_image(t.encode()) for _, t in texts)}
    assert all(stored[r.media_sha256] == r.media_bytes for r in got.itertuples())
    payload = {i: np.frombuffer(media.decode_image(media.encode_image(t.encode()))[0], np.uint8) for i, t in texts}
    for r in got.itertuples():
        found = dict(x.split("=") for x in r.feature.split(";"))
        values = payload[r.doc_id]
        assert float(found["mean"]) == pytest.approx(values.mean(), abs=1e-6) and float(found["std"]) == pytest.approx(values.std(), abs=1e-5)
        assert (int(found["min"]), int(found["max"]), int(found["distinct"])) == (values.min(), values.max(), len(set(values.tolist())))
    assert media.media_columns(empty(spark)).count() == 0


def test_media_ranges_retries_and_damage(spark, tmp_path):
    rows = spark.createDataFrame([(i, "text %d " % i * 200) for i in range(300)], "doc_id long, text string").repartition(2)
    path = f"file://{tmp_path}/archives"
    whole = media.store_texts(rows, path)
    small = spark.read.format("media_archive").option("range_bytes", 2000).load(path)
    assert small.rdd.getNumPartitions() > whole.rdd.getNumPartitions() and sorted(map(tuple, small.collect())) == sorted(map(tuple, whole.collect()))
    first = whole.orderBy("archive", "offset").first()
    file = tmp_path / "archives" / first.archive
    data = bytearray(file.read_bytes())
    data[first.offset + 60] ^= 255
    file.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        small.collect()
    (tmp_path / "archives" / "part-lost.zip").write_bytes(b"from a lost task")
    file.write_bytes(bytes(data[: first.offset + 60]) + bytes([data[first.offset + 60] ^ 255]) + bytes(data[first.offset + 61 :]))
    assert spark.read.format("media_archive").load(path).where(F.col("archive") == "part-lost.zip").count() == 0


def test_a_member_that_fails_once_is_read_again(tmp_path, monkeypatch):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as out:
        for i in range(3):
            out.writestr(f"{i}", b"x" * (10 + i))
    failed, read = [], media._member_at

    def once(stream, member):
        if member.filename == "1" and not failed:
            failed.append(member.header_offset)
            raise OSError("lost")
        return read(stream, member)

    monkeypatch.setattr(media, "_member_at", once)
    reader = media.ArchiveReader(f"file://{tmp_path}", 1 << 20)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert failed and [(r["member"], len(r["media"])) for r in rows] == [("0", 10), ("1", 11), ("2", 12)]


def test_pieces(spark, docs, texts):
    from sentencepiece import SentencePieceProcessor

    model = queries.piece_model()
    library = SentencePieceProcessor(model_proto=model)
    got = queries.piece_digests(pieces.encode_documents(docs, model)).collect()
    want = collections.Counter()
    for i, text in texts:
        ids = library.encode(text, add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, got)) == want
    assert pieces.encode_documents(empty(spark), model).count() == 0


def test_agenda_equals_library():
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_proto=queries.piece_model())
    vocabulary = pieces.MergeVocabulary(library)
    random.seed(1)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t", "\x00", "▁", "é", "漢", "😀", "<s>", "<0x41>", "tion", "0", "--", "x" * 50]
    for _ in range(1500):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        words = pieces.words_of(text)
        ids = np.frombuffer(b"".join(vocabulary.encode_words(words)), "<u4").tolist()
        assert ids == library.encode(text) == [i for w in words for i in vocabulary.encode(w)]


def test_language_model(spark, docs, texts):
    got = ngrams.score_documents(docs).collect()
    words = [(i, t.encode().lower().split() + [b"\n"]) for i, t in texts]
    learn = [w for i, w in words if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for ws in learn for w in ws)
    pair = collections.Counter(p for ws in learn for p in zip([b"\t", *ws], ws, strict=False))
    follow, context, kinds = collections.Counter(b for _, b in pair), collections.Counter(), collections.defaultdict(collections.Counter)
    for (a, _), n in pair.items():
        context[a] += n
        kinds[a][min(n, 3)] += 1
    found = lambda c: ngrams.discounts(*(sum(v == k for v in c.values()) for k in (1, 2, 3, 4)))
    d, e, n, v = found(pair), found(follow), sum(count.values()), len(count)
    less = lambda k, d: d[min(k, 3) - 1] if k else 0
    gamma = sum(less(k, e) for k in follow.values()) / len(pair)

    def p(a, b):
        low = max(0, follow[b] - less(follow[b], e)) / len(pair) + gamma / (v + 1)
        if not context[a]:
            return low
        return max(0, pair[a, b] - less(pair[a, b], d)) / context[a] + sum(kinds[a][k] * d[k - 1] for k in (1, 2, 3)) / context[a] * low

    want = collections.defaultdict(list)
    for i, ws in words:
        want[i].append((len(ws), sum(count[w] > 0 for w in ws), sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), sum(math.log10(p(a, b)) for a, b in zip([b"\t", *ws], ws, strict=False))))
    assert len(got) == len(texts)
    for r in got:
        assert r.train_tokens == n and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.base_score, r.score) == pytest.approx(want[r.doc_id][0], rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert ngrams.score_documents(empty(spark)).count() == 0


def test_model_probabilities_sum_to_one(spark):
    """After each seen or unseen word: all known words, the end, and the one share for anything unseen."""
    texts = ["a b c a b", "b c", "a a a b"]
    model = ngrams.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    arrays, hashes = ngrams.Arrays(model.path), ngrams.WordHashes()
    score = lambda t: 10 ** ngrams.score_slice(model, arrays, hashes, [t])[3][0]
    assert model.distinct == 4 and model.tokens == 14
    for context in (b"a", b"b", b"c", b"unseen"):
        # p(context, w, end) over p(w, end) leaves p(context | begin) p(w | context) over p(w | begin)
        parts = []
        for w in (b"a", b"b", b"c", b"new"):
            pair, only = score(context + b" " + w), score(w)
            first = _first_word(model, arrays, hashes, w)
            parts.append(pair / (only / first) / _first_word(model, arrays, hashes, context))
        ends = score(context) / _first_word(model, arrays, hashes, context)
        assert sum(parts) + ends == pytest.approx(1, abs=1e-6)


def _first_word(model, arrays, hashes, word):
    """p(word | begin) from the model's arrays."""
    words = np.array([ngrams.BEGIN, hashes[word]], np.uint64)
    code = words >> ngrams.HALF << ngrams.HALF
    order = np.argsort(words)
    top = ngrams.top_bits(words[order], model.bits)
    total, n1, n2, n3 = (v[np.argsort(order)][0] for v in arrays.join("context", code[order], top))
    (follow,) = (v[np.argsort(order)][1] for v in arrays.join("follow", code[order], top))
    key = np.array([words[0] >> ngrams.HALF << ngrams.HALF | words[1] >> ngrams.HALF], np.uint64)
    (count,) = arrays.join("pair", key, ngrams.shard_of(key, model.hot, model.bits))
    low = ngrams._less(np.array([float(follow)]), model.word_discount)[0] / model.pairs + model.word_gamma / (model.distinct + 1)
    d = model.pair_discount
    return ngrams._less(count.astype(float), d)[0] / total + (d[0] * n1 + d[1] * n2 + d[2] * n3) / total * low


def plain_model(learn):
    """log10 p of a word sequence under the bigram model of ``learn``, by dictionaries."""
    pair = collections.Counter(p for ws in learn for p in zip([b"\t", *ws], ws, strict=False))
    follow, context, kinds = collections.Counter(b for _, b in pair), collections.Counter(), collections.defaultdict(collections.Counter)
    for (a, _), n in pair.items():
        context[a] += n
        kinds[a][min(n, 3)] += 1
    found = lambda c: ngrams.discounts(*(sum(v == k for v in c.values()) for k in (1, 2, 3, 4)))
    d, e, v = found(pair), found(follow), len({w for ws in learn for w in ws})
    less = lambda k, d: d[min(k, 3) - 1] if k else 0
    gamma = sum(less(k, e) for k in follow.values()) / len(pair)

    def p(a, b):
        low = max(0, follow[b] - less(follow[b], e)) / len(pair) + gamma / (v + 1)
        if not context[a]:
            return low
        return max(0, pair[a, b] - less(pair[a, b], d)) / context[a] + sum(kinds[a][k] * d[k - 1] for k in (1, 2, 3)) / context[a] * low

    return lambda ws: sum(math.log10(p(a, b)) for a, b in zip([b"\t", *ws], ws, strict=False))


def test_quality_against_brute_force(spark):
    """Perplexity, thresholds by language and verdicts, by plain loops over the model's words, which are 32-bit hashes."""
    code = lambda ws: [xxhash.xxh64_intdigest(w, 0) >> 32 for w in ws]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    rows = {r.doc_id: ((r.text or "").encode().lower().split() + [b"\n"], r.lang) for r in docs.collect()}
    trusted = {r.doc_id for r in labels.collect()}
    learn = {i for i in trusted if zlib.crc32(str(i).encode()) % 2 == 0}
    score = plain_model([code(rows[i][0]) for i in learn if i in rows])
    surprise = {i: -score(code(ws)) / len(ws) for i, (ws, _) in rows.items()}
    held = [i for i in trusted - learn if i in rows and len(rows[i][0]) >= quality.MIN_TOKENS]
    rank = lambda values: sorted(values)[max(0, math.ceil(quality.QUANTILE * len(values)) - 1)] if values else None
    by_lang = collections.defaultdict(list)
    for i in held:
        by_lang[rows[i][1]].append(surprise[i])
    limit = lambda lang: rank(by_lang[lang]) if len(by_lang[lang]) >= quality.MIN_TRUSTED else rank([surprise[i] for i in held])
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        ws, lang = rows[r.doc_id]
        assert r.n_tokens == len(ws) and math.log10(r.perplexity) == pytest.approx(surprise[r.doc_id], rel=1e-9)
        assert math.log10(r.threshold) == pytest.approx(limit(lang), rel=1e-9)
        assert r.kept == (len(ws) < quality.MIN_TOKENS or surprise[r.doc_id] <= limit(lang) + 1e-12)


def brute_links(vectors, least=0.9):
    good = [i for i, v in enumerate(vectors) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dim = max((len(vectors[i]) for i in good), default=0)
    unit = {i: np.pad(np.array(vectors[i], float), (0, dim - len(vectors[i]))) for i in good}
    return [(a, b) for a in good for b in good if a != b and unit[a] @ unit[b] / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]) >= least]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    vectors = [(centres[i % 6] + rng.normal(size=16) * (0.1 if i % 3 else 1.5)).astype(np.float32).tolist() for i in range(900)]
    vectors += [vectors[0]] * 40 + [None, [], [0.0] * 16, [math.nan] * 16, [1.0, None], [math.inf] + [0.0] * 15, [2.0], [3.0, 0.0]]
    rows = [(1000 - i, v) for i, v in enumerate(vectors)]
    got = {r.vec_id: r for r in covertree.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).repartition(4)).collect()}
    links = brute_links(vectors)
    degree = collections.Counter(rows[a][0] for a, _ in links)
    assert len(got) == len(rows) and all(got[i].n_links == degree[i] for i, _ in rows)
    component = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if component[rows[b][0]] < component[rows[a][0]]:
                component[rows[a][0]], changed = component[rows[b][0]], True
    assert all(got[i].component_id == component[i] and got[i].kept == (component[i] == i) for i, _ in rows)
    assert covertree.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert covertree.link_vectors(spark.createDataFrame([(None, [1.0])], "vec_id long, embedding array<double>")).first().kept


SECRETS = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "assign", lambda m: len(m[2]) >= 8), (re.compile("AKIA[A-Z0-9]+"), "access", lambda m: len(m[0]) >= 16), (re.compile("[0-9a-f]+"), "hex", lambda m: len(m[0]) >= 32)]


def test_secrets(spark):
    random.seed(4)
    parts = ["token", "Password", "api_key", "=", ": ", '"', "abcdefgh", "AKIA", "ABCD1234EFGH", "deadbeef" * 4, "0f" * 16, "é", " ", "\n", "x", "İ", "secret", "'"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 25)))) for i in range(500)] + [(None, "token=abcdefgh"), (600, None), (601, ""), (602, "a1" * 40000)]
    got = secrets.span_digests(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(0)))).collect()
    want = {}
    for i, text in rows:
        spans = sorted((m.start(), k, m.end(), name) for k, (p, name, good) in enumerate(SECRETS) for m in p.finditer(text or "") if good(m))
        want[i] = ",".join(f"{name}:{a}:{b}" for a, _, b, name in spans)
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("crf")]
        assert ",".join(base) == want[r.doc_id] and r.base_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
    assert len(got) == len(rows)
    assert secrets.find_secrets(empty(spark)).count() == 0


@pytest.fixture(scope="module")
def field(spark):
    return secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_field_learns_beyond_the_patterns(field):
    caught = lambda text: [text[a:b] for a, b, _ in secrets.field_spans(text, field, secrets.pattern_spans(text), {})]
    assert caught('the pwd = "Xk29fjq03kfjQ02mfk3l" is') == ["Xk29fjq03kfjQ02mfk3l"]
    assert caught("the key wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY of it") == ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"]
    assert caught("auth: x7Gq29Lk1Z end") == ["x7Gq29Lk1Z"]  # ten characters after a key word
    assert caught("use ghp_x7Gq29Lk1ZpQ44mNsT0vWy8aB3cD6eF1 here") == ["ghp_x7Gq29Lk1ZpQ44mNsT0vWy8aB3cD6eF1"]
    assert caught("card 4736962573099581 of 2024-01-01, mail ab.34@mail7.example.com, +1 (017) 555-7713") == []
    assert caught("see https://example.org/some/path/to-a-page.html and a well-known-state-of-the-art thing, uncharacteristically so") == []


def test_field_on_planted_secrets(spark, field):
    """Precision and recall on generated strings of another seed in other documents; patterns find none of those counted."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 7 = 3")
    contexts = [r[0] for r in docs.select(F.substring("text", 200, 140)).where(F.length("text") > 400).collect()]
    planted = [x for x in secrets.generated(random.Random(99), contexts, 1200) if not any(a < x[2] and x[1] < b for a, b in secrets.secret_spans(x[0]))]
    rows = [(i, text) for i, (text, *_) in enumerate(planted)]
    got = {r.doc_id: [f for f in r.found if f.kind == "crf"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), field=field).collect()}
    hit = [any(f.start < b and a < f.end for f in got[i]) for i, (_, a, b, _) in enumerate(planted)]
    exact = [any((f.start, f.end) == (a, b) for f in got[i]) for i, (_, a, b, _) in enumerate(planted)]
    real = [x[3] for x in planted]
    found = sum(h and r for h, r in zip(hit, real, strict=True))
    assert found / sum(real) > 0.97 and found / sum(hit) > 0.97
    assert sum(e and r for e, r in zip(exact, real, strict=True)) / sum(real) > 0.9


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    field = secrets.Field(rng.normal(size=(secrets.FEATURES, 3)), rng.normal(size=(3, 3)))
    for _ in range(50):
        n = int(rng.integers(1, 6))
        rows = [list(rng.integers(0, secrets.FEATURES, 4)) for _ in range(n)]
        best, top = None, -np.inf
        for code in range(3**n):
            tags = [code // 3**i % 3 for i in range(n)]
            if tags[0] == 2 or any(a == 0 and b == 2 for a, b in zip(tags, tags[1:], strict=False)):
                continue
            value = sum(field.weights[r].sum(axis=0)[t] for r, t in zip(rows, tags, strict=True)) + sum(field.moves[a, b] for a, b in zip(tags, tags[1:], strict=False))
            if value > top:
                best, top = tags, value
        assert field.decode(rows) == best


def test_redacted_texts(spark, field):
    rows = [(1, "password = hunter2hunter2 and more"), (2, None), (3, "nothing here")]
    got = {r.doc_id: r.text for r in secrets.redacted_texts(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    assert got == {1: "[SECRET] and more", 2: None, 3: "nothing here"}


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    both = docs.unionByName(odd).withColumn("kept", F.lit(7)).withColumn("threshold", F.lit("t"))
    trusted = labels.where("quality = 1 and toxic = 0").select("doc_id")
    scores = quality.quality_scores(both, trusted)
    assert scores.count() == docs.count() + 1 and scores.where("doc_id is null").first().kept
    rate = {r.quality: r.kept for r in scores.join(labels.where("toxic = 0"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert rate[1] > 0.98 and rate[0] < 0.5
    good = quality.keep_good(both, trusted)
    assert good.columns == both.columns and good.count() == scores.where("kept").count()
    none = trusted.limit(0)
    assert quality.quality_scores(docs.limit(5), none).where("kept").count() == 5 and quality.quality_scores(empty(spark), trusted).count() == 0


def test_queries_are_registered():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ours, theirs = queries.queries()[name](spark, DATA).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    rows = lambda df: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(ours) == rows(theirs)


def test_quality_learns_from_all_trusted_documents(spark):
    """More trusted documents than a bounded sample of them would hold, ids below zero among them."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i - 20_000, " ".join(words[j] for j in rng.integers(0, 3000, 10)), "en") for i in range(36_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    code = lambda text: [xxhash.xxh64_intdigest(w, 0) >> 32 for w in text.encode().split() + [b"\n"]]
    score = plain_model([code(t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 2 == 0])
    got = {r.doc_id: r.perplexity for r in quality.quality_scores(docs, docs.select("doc_id")).where("doc_id % 300 = 0").collect()}
    assert len(got) == 120
    for i, t, _ in rows[200::300]:
        assert math.log10(got[i]) == pytest.approx(-score(code(t)) / 11, rel=1e-9)
