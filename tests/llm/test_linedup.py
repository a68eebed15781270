"""Lines at the edges of the lengths that the line operator treats apart."""

import pytest

import corpus_pipeline
from evigrain.llm import linedup, queries


@pytest.mark.parametrize("gone", [0, 5, 7, 8, 15])
@pytest.mark.parametrize("first", ["long", "short"])
def test_a_word_short_of_a_long_line(spark, gone, first):
    words = [f"w{i}" for i in range(linedup.LONG_WORDS)]
    texts = [" ".join(words), " ".join(words[:gone] + words[gone + 1 :])]
    rows = list(enumerate(texts if first == "long" else texts[::-1]))
    got = linedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 1)]


SHORT = [(1, "Read More\n\none two three four five"), (2, "read  more\n\nonly here"), (3, "read more\n\n \nRead more"), (4, "one two three four\nread"), (5, "one two three four five\nand this")]


def test_short_lines_are_compared_for_equality(spark, tmp_path):
    spark.createDataFrame(SHORT, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): (r.keeper_doc_id, r.keeper_line_no) for r in queries.op4_lines(spark, str(tmp_path)).where("distance = 0").collect()}
    assert got.pop((3, 3)) in {(1, 0), (2, 0), (3, 0)}  # any earlier line will do
    assert got == {(2, 0): (1, 0), (3, 0): got[3, 0], (5, 0): (1, 2)} and got[3, 0] in {(1, 0), (2, 0)}


def test_documents_with_text_of_their_own_stay(spark):
    left = corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(SHORT, "doc_id long, text string"), "")
    assert dict(map(tuple, left.collect())) == {1: SHORT[0][1], 2: "\nonly here", 4: SHORT[3][1], 5: "and this"}


def test_very_long_lines_and_rows_without_text(spark):
    words = [f"w{i % 977}x{i}" for i in range(20_000)]
    other = words[:12_345] + ["new"] + words[12_346:]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(other[:-1])), (4, None), (None, " ".join(words)), (5, "")]
    got = linedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(2, 0, 1, 0, 1), (3, 0, 2, 0, 1)]


def test_distance_of_words():
    a = [b"a", b"b", b"c"]
    assert linedup.one_word_apart(a, [b"a", b"x", b"c"]) and linedup.one_word_apart(a, [b"a", b"c"]) and linedup.one_word_apart([b"b", b"c"], a)
    assert not linedup.one_word_apart(a, a) and not linedup.one_word_apart(a, [b"a"]) and not linedup.one_word_apart(a, [b"c", b"b", b"a"])
