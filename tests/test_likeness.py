"""What a similarity join sends: bitmaps of all sets, and the sets of those alone that may be like another."""

import random

import pytest
from pyspark.sql import functions as F

from evigrain.operators import likeness, matching, relational


@pytest.fixture
def sets():
    chance = random.Random(5)
    found = [{f"w{chance.randrange(3000)}" for _ in range(chance.choice([3, 20, 90, 400, 1500]))} for _ in range(300)]
    for s in found[:12]:  # a few have a near copy
        found.append({w for i, w in enumerate(sorted(s)) if i % 12} | {"new"})
    return found


def _pairs(sets, least):
    return {(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets) if i < j and len(s & t) / len(s | t) >= least}


@pytest.mark.parametrize("least", [0.8, 0.6, 0.95])
def test_candidates_hold_all_pairs(spark, sets, least, monkeypatch):
    monkeypatch.setattr(likeness, "BLOCK_BYTES", (2048, 2048))  # many blocks
    rows = spark.createDataFrame([(i, "c", sorted(s)) for i, s in enumerate(sets)] + [(9999, "c", [])], "ident long, cell string, set array<string>")
    want, listed = _pairs(sets, least), set(range(0, len(sets), 3))
    found = [tuple(r) for r in likeness.candidates(rows, ["cell"], least).collect()]
    assert want <= set(found) and len(found) == len(set(found)) <= len(want) + 40
    marks = spark.createDataFrame([(i,) for i in listed], "id long")
    found = {tuple(r) for r in likeness.candidates(rows, ["cell"], least, marks).collect()}
    assert {(i, j) for i, j in want if (i in listed) != (j in listed)} <= found and all((i in listed) != (j in listed) for i, j in found)


def test_only_kin_is_written_out(spark, sets, monkeypatch):
    tables = {}

    def noted(df, name, written=relational.written):
        tables[name] = written(df, name)
        return tables[name]

    monkeypatch.setattr(relational, "written", noted)
    rows = spark.createDataFrame([(i, "c", sorted(s)) for i, s in enumerate(sets)], "id long, cell string, words array<string>")
    found = relational.similar_pairs(relational.token_sets(rows, "id", ["cell"], "words"), ["cell"], 0.8).collect()
    assert {(r.left_id, r.right_id) for r in found} == _pairs(sets, 0.8) and len(found) > 3
    whole = [name for name, t in tables.items() if any(kind.startswith("array") for _, kind in t.dtypes)]
    assert whole == ["standing"] and tables["standing"].count() < 40


def test_tags_compare_listed_with_others_alone(spark, sets, monkeypatch):
    asked = []

    def noted(*args, found=likeness.candidates):
        asked.append(found(*args).collect())
        return spark.createDataFrame(asked[-1], "left_id long, right_id long")

    monkeypatch.setattr(likeness, "candidates", noted)
    docs = spark.createDataFrame([(i, "c", " ".join(sorted(s))) for i, s in enumerate(sets)] + [(9999, "c", None), (9998, "c", "")], "doc_id long, cell string, text string")
    marks = {*range(6), *range(306, 312)}
    gold = spark.createDataFrame([(i,) for i in [*marks, 9998]], "doc_id long")
    tags = {r.doc_id: r.tag for r in matching.discovery_tags(docs, gold, ["cell"], 0.6, F.split("text", " ")).collect()}
    known = {*marks, 9998} | {x for i, j in _pairs(sets, 0.6) for x, y in ((i, j), (j, i)) if y in marks}
    assert {i for i, t in tags.items() if t == "KNOWN"} == known and len(known) > 18 and len(tags) == len(sets) + 2
    assert asked and all((r.left_id in marks) != (r.right_id in marks) for r in asked[0])
