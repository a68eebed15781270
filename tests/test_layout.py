"""Table parts, route tags, layout overlap, modal samples and panels on hand-made cases."""

import random

from pyspark.sql import functions as F

from evigrain.operators import overlap, relational, tables

ELEMENT = "doc_id long, element_id string, parent_id string, element_type string, char_start int, text string"


def test_table_parts(spark):
    text = "a | b|c |  d \n\n ||| \none\ttwo | 2\t\tone\r\n  single  \n|x|y"
    rows = [(1, "t", None, "table", 10, text), (1, "u", None, "table", 0, "p | q"), (1, "v", "u", "other", 0, "p"), (2, "t", None, "paragraph", 0, "p | q"), (2, "n", None, "table", 0, None), (2, "e", None, "table", 0, "")]
    got = tables.table_parts(spark.createDataFrame(rows, ELEMENT)).collect()
    cells = [(r.element_id, r.text) for r in sorted(got, key=lambda r: r.char_start) if r.element_type == "table_cell"]
    assert cells == [("t.r0.c0", "a"), ("t.r0.c1", "b|c"), ("t.r0.c2", "d"), ("t.r1.c0", "one"), ("t.r1.c1", "two | 2"), ("t.r1.c2", "one"), ("t.r2.c0", "single"), ("t.r3.c0", "x"), ("t.r3.c1", "y")]
    assert all(text[r.char_start - 10 : r.char_end - 10] == r.text and r.doc_id == 1 for r in got)
    assert {(r.element_id, r.parent_id, r.numbering) for r in got if r.element_id in ("t.r1", "t.r1.c2")} == {("t.r1", "t", "row:1"), ("t.r1.c2", "t.r1", "row:1;col:2")}


def test_route_tags(spark):
    rows = spark.createDataFrame([("table", None), ("section", ""), ("section", "x"), ("section", "route:other"), ("figure", "x"), ("figure", None), (None, "x")], "t string, e string")
    assert [r[0] for r in rows.select(tables.route_tag(F.col("t"), F.col("e"))).collect()] == ["route:tabular_lookup", "route:clause_extraction", "x|route:clause_extraction", "route:other", "x", None, "x"]


def plain_best(blocks, rows, least=0.3):
    norm, out = lambda t: " ".join((t or "").split()).lower(), {}
    for b, page, text in blocks:
        best = None
        for r, other, row in sorted(rows):
            x, y = norm(text), norm(row)
            if page != other or not x or not y:
                continue
            score = min(len(x), len(y)) / max(len(x), len(y)) if x in y or y in x else len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
            if score >= least and (best is None or score > best[1]):
                best = r, score
        if best:
            out[page, b] = best
    return out


def test_best_overlap_equals_all_pairs(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcA") for _ in range(rng.choice([1, 1, 2, 3, 6]))) for _ in range(rng.choice([0, 1, 1, 2, 3, 6])))
    blocks, rows = [(i, i % 3, text()) for i in range(120)] + [(900, 0, None)], [(i, i % 3, text()) for i in range(150)] + [(901, 0, None)]
    got = overlap.best_overlap(spark.createDataFrame(blocks, "block_id long, page int, text string"), spark.createDataFrame(rows, "row_id long, page int, text string")).collect()
    want = plain_best(blocks, rows)
    assert {(r.page, r.block_id): r.row_id for r in got} == {k: v[0] for k, v in want.items()} and len(want) > 60
    assert all(abs(r.score - want[r.page, r.block_id][1]) < 1e-9 for r in got)


def test_merged_layout(spark):
    blocks = spark.createDataFrame([(1, 0, "Short title of the Act", "paragraph", "p", None), (2, 0, "other words", "paragraph", None, "s. 2"), (3, 0, "unknown", "list_item", None, None)], "block_id long, page int, text string, element_type string, parent_id string, numbering string")
    rows = spark.createDataFrame([(1, 0, "short  TITLE of the act", "section", None, "s. 1"), (2, 0, "other words", "paragraph", "q", "s. 9")], "row_id long, page int, text string, element_type string, parent_id string, numbering string")
    assert {(r.block_id, r.element_type, r.parent_id, r.numbering) for r in overlap.merged_layout(blocks, rows).collect()} == {(1, "section", "p", "s. 1"), (2, "paragraph", "q", "s. 2"), (3, "list_item", None, None)}


def test_modal_samples(spark):
    rows = [("x", "b", 1, "s1"), ("x", "a", 2, "s2"), ("x", "a", 3, "s3"), ("x", "b", 4, "s4"), ("y", None, 1, "s5"), ("y", "c", 2, None), ("z", None, 1, "s6")]
    got = relational.modal_samples(spark.createDataFrame(rows, "claim string, choice string, at int, span string"), ["claim"], "choice", "at").collect()
    assert {tuple(r) for r in got} == {("x", "b", 1, "s1", 2, 4), ("y", "c", 2, None, 1, 1)}


def test_panels(spark):
    rows = [("a", "l1", True), ("a", "l2", True), ("a", "l3", False), ("b", "l1", True), ("b", "l2", None), ("c", "l1", True)]
    got = {r.claim: (r.refuted, r.refuted_by, r.survives, round(r.score, 3)) for r in relational.panel_verdicts(spark.createDataFrame(rows, "claim string, lens string, no boolean"), "claim", "lens", "no").collect()}
    assert got == {"a": (2, "l1,l2", False, 0.333), "b": (1, "l1", True, 0.5), "c": (1, "l1", False, 0.0)}


def test_overlap_of_a_page_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(overlap, "PAIRS", 50)  # a few blocks at a time
    text = lambda: " ".join(rng.choice(["the", "of", "data", "dat", "ata th", "ta the o", "Privacy", "rivac", "é"]) for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))
    blocks = [(i, i % 2, text()) for i in range(90)] + [(95, None, "the"), (96, 7, "alone")]
    rows = [(i, i % 2, text()) for i in range(90)] + [(95, None, "the"), (96, 8, "alone")]
    found = overlap.best_overlap(spark.createDataFrame(blocks, "block_id long, page int, text string"), spark.createDataFrame(rows, "row_id long, page int, text string"))
    want = plain_best(blocks[:90], rows[:90])
    assert {(r.page, r.block_id): (r.row_id, round(r.score, 9)) for r in found.collect()} == {k: (v[0], round(v[1], 9)) for k, v in want.items()} and len(want) > 60
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_overlap_of_a_long_page(spark):
    blocks = spark.range(4000).selectExpr("id AS block_id", "0 AS page", "concat('the section ', id % 2000, ' of the law') AS text")
    rows = spark.range(4000).selectExpr("id AS row_id", "0 AS page", "concat('the section ', id, ' of the law') AS text")
    assert {(r.block_id, r.row_id, r.score) for r in overlap.best_overlap(blocks, rows).collect()} == {(i, i % 2000, 1.0) for i in range(4000)}
