"""BPE by automaton, token alignment and vector codes against the libraries, brute force and SQL, and on odd rows."""

import collections
import hashlib
import json
import random

import duckdb
import numpy as np
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from evigrain.llm import alignment, automaton, queries, veccodes

DATA = "/root/testdata/sf0.001"
ALPHABET = "aaabbcde'st ll\t\n.,!?019éÉİΣσς́̀   한글漢字🙂‍\x00\x1c\x85\xa0▁ßﬁ<>"
ODD = [None, "", " ", "  a  b ", "<|endoftext|>x<s></s><|startoftext|>", "don't  STOP\r\n\r\n it's", "a" * 30000, "é" * 5000 + " " * 3000, "▁ mark", "ABC abc", "ABC abc", "\x00 nul", "é ́a", "<0x41> <unk>"]


def odd_texts(n=300):
    rng = random.Random(5)
    return ODD + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Real and odd texts with repeated and null ids, and columns whose names the operators use themselves."""
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows = real + [(None if i % 50 == 7 else 9000 + i // 2, t) for i, t in enumerate(odd_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({"id": F.lit(1), "block": F.lit("k"), "pairs": F.lit(2), "ids": F.lit("f")}).cache()


@pytest.fixture(scope="module")
def word_bpe():
    return queries.vocabulary_file("word_bpe_49k.json").decode()


def test_bpe_equals_library(spark, docs, word_bpe):
    theirs = tokenizers.Tokenizer.from_str(word_bpe)
    want = collections.Counter()
    for r in docs.collect():
        e = theirs.encode(r.text or "", add_special_tokens=False)
        want[r.doc_id, len(e.ids), " ".join(map(str, e.ids)), theirs.decode(e.ids, skip_special_tokens=False)] += 1
    got = automaton.encode_documents(docs, word_bpe)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert collections.Counter(map(tuple, got.collect())) == want
    assert automaton.encode_documents(spark.createDataFrame([], "doc_id long, text string"), word_bpe).count() == 0


def test_latin_texts_need_no_library(word_bpe):
    """Every character below the bound, between letters, digits and others, is cut as the library cuts it."""
    theirs = tokenizers.Tokenizer.from_str(word_bpe)
    config = json.loads(word_bpe)
    coder = automaton.WordCoder(theirs, automaton.compile_merges(config), config)
    rng = random.Random(8)
    texts = [f"{a}{chr(c)}{b}" for c in range(0x250) for a, b in (("a", "b"), ("1", "2"), (" ", " "), ("'", "s"), ("!", "?"))]
    texts += ["".join(chr(rng.randrange(0x250)) if rng.random() < 0.3 else rng.choice("ab'sDREV1 ") for _ in range(30)) for _ in range(400)]
    for text in texts:
        assert coder.latin
        assert coder.words(text) == [w for w, _ in theirs.pre_tokenizer.pre_tokenize_str(theirs.normalizer.normalize_str(text))], text


def test_automaton_of_small_merges():
    """Words of repeated letters, where the gadget's copies lack their own token, against merging by rank."""
    rng = random.Random(3)
    for _ in range(40):
        vocab = {"a": 0, "b": 1}
        merges = []
        while len(merges) < 8:
            pair = rng.choice(list(vocab)), rng.choice(list(vocab))
            if "".join(pair) not in vocab:
                merges.append(list(pair))
                vocab["".join(pair)] = len(vocab)
        model = tokenizers.models.BPE(vocab, [tuple(m) for m in merges])
        encoder = automaton.Encoder(automaton.compile_merges({"model": {"vocab": vocab, "merges": merges}}))
        for word in {"".join(rng.choice("aab") for _ in range(rng.randint(1, 14))) for _ in range(60)}:
            want = plain_merge(word, merges, vocab)
            assert encoder.encode(word) == want and [t.id for t in model.tokenize(word)] == want


def plain_merge(word, merges, vocab):
    symbols = list(word)
    for a, b in merges:
        out = []
        for s in symbols:
            if out and out[-1] == a and s == b:
                out[-1] = a + b + "\0"  # can't be merged again in this pass
            else:
                out.append(s)
        symbols = [s.rstrip("\0") for s in out]
    return [vocab[s] for s in symbols]


def test_bpe_of_long_words_and_unknown_symbols(word_bpe):
    theirs = tokenizers.Tokenizer.from_str(word_bpe)
    encoder = automaton.Encoder(automaton.compile_merges(json.loads(word_bpe)))
    for word in ("ab" * 100_000, "a" * 200_001, "thethe" * 30_000):
        assert encoder.encode(word) == theirs.encode(word, add_special_tokens=False).ids
    small = automaton.Encoder(automaton.compile_merges({"model": {"vocab": {"a": 0}, "merges": []}}))
    with pytest.raises(ValueError):
        small.encode("ax")


def test_alignment_against_brute_force(spark, docs, monkeypatch):
    byte_json, model = queries.vocabulary_file("byte_bpe_50k.json").decode(), queries.piece_model()
    a, b = tokenizers.Tokenizer.from_str(byte_json), sentencepiece.SentencePieceProcessor(model_proto=model)
    a.encode_special_tokens = True
    symbols = automaton.byte_symbols()
    labels = {i: bytes(symbols[c] for c in s) if i != 50256 else b"" for s, i in a.get_vocab().items()}
    rows, held = [], collections.Counter()
    for r in docs.collect():
        ids_a, ids_b = a.encode(" " + (r.text or ""), add_special_tokens=False).ids, b.encode(r.text or "")
        cut = [[labels[i] for i in ids_a], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]]
        if not r.text or any(b"".join(x) != (" " + r.text).encode() for x in cut):
            rows.append((r.doc_id, [], [], [], ""))
            continue
        spans = [list(zip(np.cumsum([0] + [len(p) for p in x]).tolist(), np.cumsum([len(p) for p in x]).tolist())) for x in cut]
        if len(ids_a) * len(ids_b) > 4_000_000:
            links = near_links(spans)
        else:
            links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (s2, e2) in enumerate(spans[1]) if s < e2 and s2 < e]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        at_a, at_b = ({e: k + 1 for k, (_, e) in enumerate(s)} for s in spans)
        groups, i, j = [], 0, 0
        for e in ends:
            groups.append(",".join(map(str, ids_a[i : at_a[e]])) + "|" + ",".join(map(str, ids_b[j : at_b[e]])))
            i, j = at_a[e], at_b[e]
        pairs = [(ids_a[i], ids_b[j]) for i, j in links]
        held.update(set(pairs))
        rows.append((r.doc_id, ids_a, ids_b, pairs, ";".join(groups)))
    top = collections.defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    want = collections.Counter()
    for ident, ids_a, ids_b, pairs, groups in rows:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        want[ident, len(ids_a), len(ids_b), groups.count(";") + 1 if groups else 0, len(pairs), sum(held[p] == top[p[0]] for p in pairs), sum(held[p] for p in pairs), digest] += 1
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 5000)  # many blocks
    got = alignment.align_tokens(docs, byte_json, model)
    assert collections.Counter(map(tuple, got.collect())) == want
    whole = alignment.align_tokens(docs, byte_json, model, with_groups=True).collect()
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in whole)
    assert {r.groups for r in whole} == {r[4] for r in rows}
    assert alignment.align_tokens(spark.createDataFrame([], "doc_id long, text string"), byte_json, model).count() == 0


def near_links(spans):
    out, j = [], 0
    for i, (s, e) in enumerate(spans[0]):
        while spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < e:
            out.append((i, k))
            k += 1
    return out


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Rows ``(id, vector, label)`` in any order."""
    rows = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0], len(r[1]), r[1]))
    width = -(-max(len(r[1]) for r in rows) // parts)
    x = np.zeros((len(rows), parts * width), np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r[1])] = np.floor(4096 * np.array(r[1], np.float32).astype(float)).clip(-(1 << 27), 1 << 27)
    x = x.reshape(len(rows), parts, width)
    books = x[:entries].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        far = ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
        near = far.argmin(axis=2)
        if step < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    if (near[:, p] == e).any():
                        books[p, e] = x[near[:, p] == e, p].sum(axis=0) // (near[:, p] == e).sum()
    error = far.min(axis=2).sum(axis=1)
    by_label = collections.Counter()
    for r, e in zip(rows, error.tolist()):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return collections.Counter((r[0], "".join(f"{c:02x}" for c in n), e, by_label[r[2]], digest) for r, n, e in zip(rows, near.tolist(), error.tolist()))


def vector_frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df.withColumns({"id": F.lit(1), "v": F.lit(2), "code": F.lit("c"), "part": F.lit(0)})


def test_codes_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    near = [(i, (np.round(rng.normal(size=16)) / 8 + (i % 3)).tolist(), None if i % 5 == 0 else i % 3) for i in range(700)]  # many ties
    odd = [(None, [0.5] * 16, 1), (3, [0.25] * 16, 7), (3, [0.25] * 16, 7), (1000, None, 1), (1001, [None] * 16, 1), (1002, [float("nan")] * 16, 2), (1003, [float("inf")] * 16, 2), (1004, [1e30] * 16, 2), (1005, [1.0] * 3, 2), (1006, [], 2)]
    monkeypatch.setattr(veccodes, "BLOCK_ROWS", 100)
    for rows in (near + odd, near[:5], [(i, [0.5] * 9, 1) for i in range(40)]):
        got = veccodes.encode_vectors(vector_frame(spark, rows))
        assert collections.Counter(map(tuple, got.collect())) == plain_codes(rows)
    for limit in (0, 100_000):  # sums by label shuffled, and broadcast
        monkeypatch.setattr(veccodes, "BROADCAST_LABELS", limit)
        assert collections.Counter(map(tuple, veccodes.encode_vectors(vector_frame(spark, near[:60])).collect())) == plain_codes(near[:60])
    assert veccodes.encode_vectors(vector_frame(spark, [(1, None, 1)])).count() == 0
    assert [r.code for r in veccodes.encode_vectors(vector_frame(spark, [(1, [], 1)])).collect()] == ["00" * 8]
    assert veccodes.encode_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_filtering_assigns_subtrees():
    """Boxes decide for whole subtrees where vectors lie in clumps, and each row is covered once."""
    rng = np.random.default_rng(4)
    points = (rng.integers(0, 8, (4000, 1)) * 1000 + rng.integers(0, 30, (4000, 8))).astype(np.int64)
    tree = veccodes.Tree.unpack(veccodes.Tree.over(points).pack())
    book = points[rng.integers(0, 4000, 16)]
    entries, error = veccodes.assignments(tree, book)
    far = ((points[:, None] - book) ** 2).sum(axis=2)
    assert (entries == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
    single = sum(len(found) for level, found, _ in veccodes.filtered(tree, book) if level < 0)
    assert single < 4000
    total, count = veccodes.entry_sums(tree, book)
    assert count.sum() == 4000 and (total.sum(axis=0) == points.sum(axis=0)).all()


def test_codes_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.execute(queries.oracle_sql()["op12_codes"]).df()
    got = queries.op12_codes(spark, DATA).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))


def test_chunks_met_again_are_not_encoded_again():
    """The words of some thousands of documents, met twice; white space of any kind keeps the cuts."""
    coder, encoded = alignment.PairCoder.__new__(alignment.PairCoder), []
    coder.known, coder.before = {}, {}
    coder._learn = lambda chunks: (encoded.extend(chunks), coder.known.update(dict.fromkeys(chunks)))
    for _ in range(2):
        for at in range(0, 290_000, 10_000):
            coder.learn({f" w{i}" for i in range(at, at + 10_000)})
    assert len(encoded) == len(set(encoded)) == 290_000
    for text in ("a b", "a  b", " a b", "a b ", "a\n", "a\nb c", "a b c", "a 　b", "\x1ca b", " ", "a", "a\n b  c d"):
        assert alignment.chunks_of(text) == [" " + c for c in alignment.CUT.split(text)]
