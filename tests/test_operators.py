"""Operators on small cases with results worked out by hand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evigrain.functions import text as T
from evigrain.operators import export, relational, rules
from evigrain.operators.elements import chunk_spans
from evigrain.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("recall", "percent"), [(1.0, 0), (0.99, 1), (0.95, 5), (0.90, 10), (0.82, 18), (0.5, 50), (0.18, 82), (0.01, 99), (0.0, 100)])
def test_miss_percent(spark, recall, percent):
    assert one(spark, rules.miss_percent(F.lit(recall))) == percent


def test_fusion(spark):
    left = spark.createDataFrame([(1, "A", 1), (1, "B", 2)], "q int, item string, rank int")
    right = spark.createDataFrame([(1, "A", 3), (1, "B", 1)], "q int, item string, rank int")
    got = {r["item"]: r.score for r in relational.fused(left, right, ["q"], "item").collect()}
    assert got["A"] == pytest.approx(1 / 61 + 1 / 63) and got["B"] == pytest.approx(1 / 62 + 1 / 61) and got["B"] > got["A"]


def test_majority(spark):
    votes = [(1, "x"), (1, "x"), (1, "y"), (2, "x"), (2, "y"), (2, "z"), (3, "b"), (3, "a")]
    got = {r.k: r for r in relational.majority(spark.createDataFrame(votes, "k int, v string"), ["k"], "v").collect()}
    assert (got[1].winner, got[1].passed, round(got[1].share, 3)) == ("x", True, 0.667)
    assert (got[2].winner, got[2].passed) == ("x", False) and (got[3].winner, got[3].passed) == ("a", False)


def test_intervals_touch(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 10, 11), (1, 4, 4)], "k int, a int, b int")
    assert sorted((r.a, r.b, r.parts) for r in relational.merged_intervals(rows, ["k"], "a", "b").collect()) == [(0, 8, 2), (10, 11, 1)]


@pytest.mark.parametrize(("a", "b", "want"), [(["a", "b", "c"], ["b", "c", "d"], 0.5), ([], [], 1.0), (["a"], [], 0.0)])
def test_jaccard(spark, a, b, want):
    as_array = lambda v: F.lit(v) if v else F.expr("cast(array() as array<string>)")
    assert one(spark, T.jaccard(as_array(a), as_array(b))) == want


@pytest.mark.parametrize(("ident", "want"), [("6.4", "P6-I4"), ("06.04", "P6-I4"), ("P12-I10", "P12-I10"), ("6.4.1", None)])
def test_indicator_alias(spark, ident, want):
    assert one(spark, T.display_indicator(F.lit(ident))) == want


def test_coverage_states(spark):
    state = lambda e, r: one(spark, rules.coverage_state(F.lit(e), F.lit(r).cast("double")))
    assert [state(True, None), state(False, 0.82), state(False, None)] == ["evidence_found", "no_evidence_in_searched_corpus", "insufficient_coverage"]
    zero = lambda reach: one(spark, rules.defensible_zero(F.lit("no_evidence_in_searched_corpus"), F.lit(0.8), F.lit(reach)))
    assert zero(0.9) and not zero(0.89)


def test_band_pick(spark):
    assert one(spark, rules.band_pick(F.lit(1.0), F.lit(1.3), F.lit(0.2))) == "0.5"
    assert one(spark, rules.band_pick(F.lit(3.0), F.lit(1.3), F.lit(0.2))) == "0"
    assert one(spark, rules.band_pick(F.lit(0.0), F.lit(0.0), F.lit(0.0))) == "0.5"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab cé\n", max_size=200), st.integers(3, 30), st.integers(0, 20))
def test_chunks_keep_offsets_and_go_on(text, target, overlap):
    spans = chunk_spans(text, target, overlap)
    assert all(a < b for a, b in spans) and all(x[0] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_csv_is_exact(spark, tmp_path):
    row = {c: "" for c in rules.PROVISION_COLUMNS} | {"economy": "A", "law_name": 'The "Act", 2020', "verbatim_snippet": " two\nlines "}
    export.write_csv(spark.createDataFrame([row]).select(*rules.PROVISION_COLUMNS), str(tmp_path / "out"))
    data = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("*.txt")))
    assert data == ",".join(rules.PROVISION_COLUMNS) + '\r\nA,"The ""Act"", 2020",,,,,,," two\nlines ",,,,\r\n'


def test_merge_and_latest_report(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c\0"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, export.merged(new, old, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    gates = spark.createDataFrame([(1, 1, "g", 1), (2, 1, "g", 5), (3, 1, "h", 2), (4, 2, "g", 1)], "id int, claim_id int, gate string, ran_at int")
    assert sorted(r.id for r in export.latest_report(gates, ["g", "h"]).collect()) == [2, 3]


def test_stream_matches_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.windowed_costs(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), late="60 days")
    run = stream.writeStream.format("memory").queryName("costs").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("costs").agg(F.sum("calls")).first()[0] == rows.count()
