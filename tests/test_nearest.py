"""Nearest rows by dot products against all pairs: ties, copies, several blocks, unusual vectors."""

import random

import pytest

from evigrain.operators import nearest

SCHEMA = "vec_id long, embedding array<float>"


def _want(rows, k):
    found = {}
    for i, q in rows:
        if i % 5 == 0:
            scored = [(-round(sum(a * b for a, b in zip(q, v, strict=True)), 6), j) for j, v in rows if j != i]
            found |= {(i, rank): (j, -minus + 0.0) for rank, (minus, j) in enumerate(sorted(scored)[:k], 1)}
    return found


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(nearest, "BLOCK", 4 * 30)
        monkeypatch.setattr(nearest, "ASKED_BLOCK", 4 * 7)
        monkeypatch.setattr(nearest, "ROWS", 3)
    chance = random.Random(3)
    kinds = [[chance.choice([-1.0, 0.0, 0.5, 0.0009765625]) for _ in range(4)] for _ in range(9)]
    rows = [(i, [0.5, 0.5, 0.0, 0.0] if i % 3 else chance.choice(kinds) if i % 2 else [chance.uniform(-1, 1) // 2**-12 * 2**-12 for _ in range(4)]) for i in range(200)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest.top_products(spark.createDataFrame(rows, SCHEMA), "vec_id % 5 = 0", 6).collect()}
    want = _want(rows, 6)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(want) == 240
    assert all(abs(got[k][1] - v[1]) < 1e-9 for k, v in want.items())


def test_pairs_are_no_rows(spark):
    """Blocks are multiplied in tasks, and no pair of usual vectors becomes a row."""
    rows = spark.range(3000).selectExpr("id AS vec_id", "transform(sequence(1, 64), i -> CAST(sin(id * i) AS FLOAT)) AS embedding")
    found = nearest.top_products(rows, "vec_id % 5 = 0", 10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and found.count() == 6000


def test_unusual_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, []), (7, [0.25, 1.0]), (10, [float("inf"), 1.0])]
    got = {}
    for r in sorted(nearest.top_products(spark.createDataFrame(rows, SCHEMA), "vec_id % 5 = 0", 9).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [4, 10, 1, 7, 2, 3, 5, 6] and set(got) == {0, 5, 10} and len(got[5]) == len(got[10]) == 8
    assert nearest.top_products(spark.createDataFrame([], SCHEMA), "vec_id % 5 = 0", 9).count() == 0
