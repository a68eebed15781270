"""The pipeline's stages, each on what the stage before it keeps."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from evigrain.llm import linedup, mixing, nearcopies, quality, queries
from evigrain.llm.staging import staged

DATA = "/root/testdata/sf0.01"


def near_copies(texts):
    """The smallest id of each group of near copies, by comparing sets that share a shingle."""
    sets, where, root = {i: set(nearcopies.shingle_set(t, 5).tolist()) for i, t in texts.items()}, collections.defaultdict(list), {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        shared = collections.Counter(j for h in sets[i] for j in where[h])
        if not sets[i]:
            shared = {j: 0 for j in sets if j < i and not sets[j]}
        for j, n in shared.items():
            if not sets[i] or n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for h in sets[i]:
            where[h].append(i)
    return sorted(i for i in root if find(i) == i)


@pytest.fixture(scope="module")
def stages(spark):
    docs, found = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    found["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = found[name] = staged(stage(spark, docs, DATA), name)
    return found


def test_columns(stages):
    for name in ("quality", "lines", "near_copies", "mix"):
        assert stages[name].columns == stages["documents"].columns


def test_quality_keeps_trusted_documents(spark, stages):
    trusted = queries.trusted_ids(spark, DATA)
    assert stages["quality"].join(trusted, "doc_id", "left_semi").count() >= 0.98 * trusted.count()


def test_no_line_is_left_that_repeats(stages):
    assert linedup.removed_lines(stages["lines"]).where("distance = 0").count() == 0
    assert stages["lines"].where(F.col("n_chars") != F.length("text")).count() == 0


def test_one_of_each_group_stays(stages):
    """Against all pairs of shingle sets that share a shingle, at a similarity of 0.8."""
    texts = {r.doc_id: r.text for r in stages["lines"].select("doc_id", "text").collect()}
    assert sorted(r.doc_id for r in stages["near_copies"].select("doc_id").collect()) == near_copies(texts)


def test_near_copies_of_a_text_are_found(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    rows = [(0, " ".join(words))]
    for k in range(1, 9):
        copy = list(words)
        for i in rng.integers(0, 400, 6):
            copy[i] = f"new{k}{i}"
        rows.append((k, " ".join(copy)))
    rows += [(100 + k, " ".join(f"w{i}" for i in rng.integers(0, 5000, 400))) for k in range(50)]
    got = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    assert sorted(r.doc_id for r in got.collect()) == [0, *range(100, 150)]


def test_mix_repeats_at_most_three_times(stages):
    assert stages["mix"].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert stages["encode"].count() == stages["mix"].count()


def test_run_equals_the_stages(spark, stages):
    run = corpus_pipeline.run(spark, DATA)
    key = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, run.select(*key).collect())) == sorted(map(tuple, stages["encode"].select(*key).collect()))


ODD = [(1, "one two three four five six seven eight", "en", "a"), (1, "one two three four five six seven eight", "en", "a"), (2, "one two three four five six seven eight", None, "b"), (None, "a line of quite a few words that stands alone", "en", None), (None, None, None, None), (5, None, "en", "a"), (6, "", "en", "a"), (7, "alpha beta\nalpha beta", "en", "b"), (8, "first text of this id here", "en", "b"), (8, "alpha beta\nsecond text of this id", "en", "b"), (9, "w " * 30_000, "xx", "c")]


def test_texts_that_share_an_id_lose_lines(spark):
    """Ids that name several texts: lines that repeat among these, and those that other documents have, go; equal rows lose the same ones."""
    a, b, c = ("the quick brown fox jumps over a dog", "five words stand in here", "one more line of text in here")
    given = [(4, f"{a}\n{b}"), (4, f"{c}\n{a}"), (4, f"{c}\n{a}"), (4, None), (9, f"{b}\nkept by nine alone it is")]
    got = corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(given, "doc_id int, text string"), DATA)
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == ["doc_id", "text"] and (9, given[4][1]) in rows and (4, None) in rows
    rest = sorted(t for i, t in rows if i == 4 and t)
    assert rest in ([a, c, c], sorted([f"{c}\n{a}"] * 2)), rest


@pytest.mark.parametrize("name", ["quality", "lines", "near_copies", "mix", "encode"])
def test_odd_rows_in_each_stage(spark, name):
    """Nulls, repeated rows and ids, empty and long texts, and columns with names that the stages use themselves."""
    clash = {c: F.lit(1) for c in ("id", "key", "row", "first", "times", "kept", "_id", "_removed", "_copy", "_times", "col", "wanted", "line", "the word")}
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text")).withColumns(clash)
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, DATA)
    rows = [(r.doc_id, getattr(r, "text", None)) for r in got.collect()]
    given = [(i, t) for i, t, *_ in ODD]
    order = lambda x: sorted(x, key=str)
    assert name == "encode" or got.columns == docs.columns
    if name == "quality":
        assert set(map(str, rows)) <= set(map(str, given)) and all((i, t) in rows for i, t in given if not t)
    elif name == "lines":
        want = [(i, t) for i, t in given if i not in (2, 7) and t != ODD[9][1]]  # 8 names two texts; the second one loses the line that 7 has
        assert order(rows) == order([*want, (7, "alpha beta"), (8, "second text of this id")])
    elif name == "near_copies":
        want = [x for x in given if x not in {(2, given[0][1]), (6, ""), (None, None)}]
        want.remove(given[0])  # one of the repeated rows
        assert order(rows) == order(want)
    elif name == "mix":
        assert set(rows) <= {x for x in given if x[1]} and all(rows.count(x) <= 3 * given.count(x) for x in rows)
        assert sum(rows.count(x) for x in set(rows) if x[0] == 1) <= 6
    else:
        assert len(rows) == len(given)
    assert stage(spark, docs.limit(0), DATA).count() == 0


def test_run_against_brute_force(spark, tmp_path):
    """All stages on whole tables: lines, near copies, mix and encoding by plain loops; quality by its operator, which has a test of its own."""
    small = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in quality.quality_scores(docs, queries.trusted_ids(spark, small)).where("kept").collect()}
    rows = {r.doc_id: (r.text, r.source) for r in docs.collect() if r.doc_id in kept}

    seen, texts = [], {}
    for i in sorted(rows):
        left = []
        for line in rows[i][0].split("\n"):
            words = line.encode().lower().split()
            near = any(words == e or (min(len(words), len(e)) >= linedup.MIN_WORDS and abs(len(words) - len(e)) < 2 and linedup.one_word_apart(words, e)) for e in seen) if words else False
            if words:
                seen.append(words)
            if not near:
                left.append(line)
        if "".join(left).strip() or left == rows[i][0].split("\n"):
            texts[i] = "\n".join(left)
    texts = {i: texts[i] for i in near_copies(texts)}

    mixed = mixing.mix_sources(spark.createDataFrame([(i, t, rows[i][1]) for i, t in texts.items()], "doc_id long, text string, source string")).collect()
    taken = collections.Counter()
    for r in mixed:
        taken[r.source] += r.taken
    library = SentencePieceProcessor(model_proto=queries.piece_model())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = collections.Counter(r.doc_id for r in got)
    assert set(times) <= set(texts)
    for source in {s for _, s in rows.values()}:
        of = [i for i in texts if rows[i][1] == source]
        words = sum(times[i] * len(texts[i].split()) for i in of)
        longest = max((len(texts[i].split()) for i in of), default=0)
        assert abs(words - taken[source]) <= 3 * longest + 0.6 * sum(len(texts[i].split()) for i in of if 0 < times[i])
    for r in got:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
