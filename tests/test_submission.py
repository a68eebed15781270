"""Hand-made cases of submissions, second-layer recommendations, passage recall, costs and the coverage grid."""

import json

import pytest
from pyspark.sql import functions as F

from evigrain.operators import costs, export, review, rules, scoring, submission

CLAIM = "claim_id string, jurisdiction string, indicator_id string, clause_id string, spans array<struct<doc_id: string, char_start: int, char_end: int>>, subject string, constraint string, model_confidence double"


def _records(spark, claims, reports=(), tags=()):
    elements = spark.createDataFrame([("d1_p2", "  Data stays here. More.", 100, "s. 2(1)", 3), ("d2_p0", "Second law", 0, None, 0)], "element_id string, text string, char_start int, numbering string, page int")
    documents = spark.createDataFrame([("d1", "Act One", "https://a/1"), ("d3", None, "")], "doc_id string, title string, source_url string")
    sources = spark.createDataFrame([("d1", "Source One", "No. 1", None, "https://s/1"), ("d2", "Source Two", "", "2020", "https://s/2")], "source_id string, title string, law_number_ref string, last_amended string, source_url string")
    made = spark.createDataFrame(claims, CLAIM)
    said = spark.createDataFrame(list(reports), "claim_id string, status string")
    return {r.claim_id: r for r in submission.provision_records(made, elements, documents, sources, said, spark.createDataFrame(list(tags), "claim_id string, discovery_tag string")).collect()}


def test_provisions_fall_back(spark):
    claims = [
        ("a", "X", "6.4", "d1_p2", [("d1", 2, 18)], "firm", "y" * 400, 0.5),  # offsets in the element
        ("b", "X", "6.4", "d1_p2", [("d1", 102, 118)], None, None, None),  # offsets in the document
        ("c", "X", "odd", "d2_p0", [("d2", 900, 950)], "s", "c", 1.0),  # offsets nowhere: the whole element
        ("d", "X", "6.4", "d2_p0", [], "s", "c", 1.0),  # no span: the clause names the document
        ("e", None, None, "gone_p1", None, "s", "c", 1.0),  # nothing is known
        ("f", "X", "6.4", "d2_p0", [("d2", 0, 6)], "s", "c", 1.0),
        ("g", "X", "6.4", "d1_p2", [("d3", 4, 4)], "s", "c", 1.0),  # an empty span
    ]
    found = _records(spark, claims, [("a", "verified"), ("f", "rejected")], [("a", "KNOWN")])
    assert sorted(found) == ["a", "b", "c", "d", "e", "g"]
    a, b, c, d, e, g = (found[x] for x in "abcdeg")
    assert (a.verbatim_snippet, a.article, a.location_reference, a.law_name, a.law_number_ref, a.source_url) == ("Data stays here.", "s. 2(1)", "page 3", "Act One", "No. 1", "https://a/1")
    assert (a.indicator_id, a.discovery_tag, a.confidence, a.notes, len(a.mapping_rationale)) == ("P6-I4", "KNOWN", "0.50", "layer1_status=verified", 300)
    assert (b.verbatim_snippet, b.confidence, b.mapping_rationale, b.notes) == ("Data stays here.", "", ": ", "layer1_status=pending_verification")
    assert (c.verbatim_snippet, c.article, c.location_reference, c.law_name, c.law_number_ref, c.last_amended, c.indicator_id) == ("Second law", "para p0", "", "Source Two", "Source Two", "2020", "odd")
    assert (d.verbatim_snippet, d.law_name, d.source_url) == ("Second law", "d2_p0", "")
    assert (e.economy, e.law_name, e.verbatim_snippet, e.article, e.indicator_id, e.discovery_tag) == ("", "gone_p1", "", "", "", "NEW")
    assert (g.law_name, g.source_url, g.verbatim_snippet) == ("d3", "", "Data stays here. More.")


def test_no_claims_no_provisions(spark):
    assert _records(spark, []) == {}


def _provisions(spark):
    row = {c: "x" for c in rules.PROVISION_COLUMNS} | {"article": "s. 1(1)", "confidence": "0.50", "discovery_tag": "NEW", "indicator_id": "P6-I4"}
    rows = [{**row, "claim_id": "1"}, {**row, "claim_id": "2", "discovery_tag": "KNOWN", "indicator_id": "odd"}]
    return spark.createDataFrame(rows)


def test_json_has_fields_of_its_own(spark):
    rows = submission.extended(_provisions(spark).withColumn("raw_context_before", F.lit("before"))).orderBy("indicator_id").collect()
    assert rows[0].asDict()["indicator_id_decimal"] == "6.4" and rows[1].indicator_id_decimal == "odd"
    assert (rows[0].pdf_is_scanned, rows[0].retrieval_method, rows[0].ocr_quality_cer, rows[0].raw_context_before, rows[0].raw_context_after) == (False, "hybrid_parent_document", None, "before", "")


def test_submission_is_written_whole(spark, tmp_path):
    paid = spark.createDataFrame([("usd", "1.5"), ("model", "abc"), ("none", None)], "metric string, value string")
    summary = submission.write_submission(_provisions(spark).repartition(2), paid, str(tmp_path), "SG", ["6", "7"], "t0", "m").collect()
    assert [tuple(r) for r in summary] == [("SG_P6-7_t0.csv", "SG_P6-7_t0.json", 2, 1, 1, 1)]
    lines = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "SG_P6-7_t0.csv").glob("*.txt"))).split("\r\n")
    assert lines[0] == ",".join(rules.PROVISION_COLUMNS) and len(lines) == 4 and lines[3] == ""
    head = [json.loads(x) for p in (tmp_path / "SG_P6-7_t0.json" / "head").glob("*.json") for x in p.read_text().splitlines()]
    assert head == [{"economy": "SG", "pillar_ids": ["6", "7"], "generated_at": "t0", "model_version": "m", "counts": {"provisions": 2, "new": 1, "known": 1}, "cost": {"usd": 1.5}}]
    rows = [json.loads(x) for p in (tmp_path / "SG_P6-7_t0.json" / "provisions").glob("*.json") for x in p.read_text().splitlines()]
    assert len(rows) == 2 and all(r["ocr_quality_cer"] is None and len(r) == 21 for r in rows)


def test_csv_parts_keep_the_header_first(spark, tmp_path):
    for one in (False, True):
        export.write_csv(_provisions(spark).repartition(3), str(tmp_path / str(one)), one)
        parts = [p.read_bytes().decode() for p in sorted((tmp_path / str(one)).glob("*.txt"))]
        assert parts[0].startswith("economy,law_name") and "".join(parts).count("\r\n") == 3 and (len(parts) == 1) == one


INDICATORS = [("6.1", "Transfer", {"0": "free flow", "0.5": "some limits", "1": "ban on transfer", "x": "ignored"}, ["transfer"], ["unless"], "conditional_regime"), ("6.2", "Bare", None, None, None, None)]


def _recommended(spark, claims, coverage, counted=None, examples=()):
    made = spark.createDataFrame(claims, "claim_id int, jurisdiction string, indicator_id string, status string, text string, clause_pattern string, members int, exceptions int, definitions int")
    dims = spark.createDataFrame(INDICATORS, "indicator_id string, name string, criteria map<string, string>, positive array<string>, negative array<string>, clause_pattern string")
    cover = spark.createDataFrame(coverage, "jurisdiction string, indicator_id string, state string, reason string")
    known = spark.createDataFrame(list(examples), "ord int, label string, band string, text string")
    marks = made if counted is None else made.where(F.col("claim_id").isin(counted))
    return made, scoring.recommendations(made, dims, cover, marks, known)


FOUND = [("A", "6.1", "evidence_found", None), ("A", "6.2", "evidence_found", None)]


@pytest.mark.parametrize(
    ("text", "pattern", "band"),
    [
        ("a ban on any transfer", "prohibition", "1"),  # 3.25 for 1, .25 for the others
        ("free flow", "prohibition", "0"),
        ("ban on transfer unless", "conditional_regime", "1"),  # 1: 3 + .25 - .5 - .25; 0.5: .25 + .25 + .5 + .75
        ("ban unless", "conditional_regime", "0.5"),
        ("free limits", "prohibition", "0.5"),  # a tie
        ("", "prohibition", "0.5"),
        (None, "prohibition", "0.5"),
    ],
)
def test_band_of_criteria(spark, text, pattern, band):
    _, found = _recommended(spark, [(1, "A", "6.1", "verified", text, pattern, 2, 1, 1)], FOUND)
    row = found.first()
    assert row.band == band and f"recommended band {band}. Rubric: " in row.rationale


def test_example_outweighs_criteria(spark):
    claims = [(1, "A", "6.1", "verified", "a ban on any transfer", "prohibition", 2, 1, 1)]
    assert _recommended(spark, claims, FOUND, examples=[(1, "", "0", "a ban on all")])[1].first().band == "0"
    assert _recommended(spark, claims, FOUND, examples=[(1, "6.2", "0", "a ban on all")])[1].first().band == "1"


def test_no_band_without_counted_evidence(spark):
    claims = [(1, "A", "6.1", "verified", "ban", "prohibition", 2, 1, 1), (2, "B", "6.1", "verified", "ban", "conditional_regime", None, None, None), (3, "C", "6.1", "verified", "ban", None, 1, 0, 1), (4, "D", "6.1", "verified", "x", "p", 2, 1, 1), (5, "A", "6.1", "flagged", "x", "p", 2, 1, 1), (6, "A", "6.9", "verified", "x", "p", 2, 1, 1)]
    coverage = [*FOUND, ("B", "6.1", "insufficient_coverage", "no recall"), ("C", "6.1", "no_evidence_in_searched_corpus", ""), ("C", "6.1", "evidence_found", "")]
    made, found = _recommended(spark, claims, coverage, [2, 3])
    rows = {r.claim_id: r for r in found.collect()}
    assert sorted(rows) == [1, 2, 3] and all(r.band is None for r in rows.values())
    assert rows[1].rationale == scoring.NOT_COUNTED and rows[1].open_questions == [scoring.ASK_PATTERN % ("prohibition", "conditional_regime")]
    assert rows[2].rationale == "No verified evidence band recommended — coverage is insufficient_coverage (no recall)."
    assert rows[2].open_questions == [scoring.ASK_COVERAGE, scoring.ASK_MEMBERS, scoring.ASK_EXCEPTIONS, scoring.ASK_DEFINITIONS]
    assert rows[3].rationale.endswith("no_evidence_in_searched_corpus.") and rows[3].open_questions[:2] == [scoring.ASK_NO_EVIDENCE, scoring.ASK_MEMBERS]
    stored = scoring.on_claims(made, found)
    assert stored.count() == 6 and stored.where("layer2 is null").count() == 3
    back = {r.claim_id: r for r in scoring.listed(stored).collect()}
    assert sorted(back) == [1, 2, 3] and back[2].recommended_band == "null" and back[2].human_confirmation_required and back[2].open_questions == rows[2].open_questions


def test_rationale_and_indicators_without_criteria(spark):
    _, found = _recommended(spark, [(1, "A", "6.2", "verified", "x", "prohibition", 3, None, 2)], FOUND)
    row = found.first()
    assert row.rationale == f"Structure = Bare (prohibition); recommended band 0.5. Regime assembly: 3 member(s), 0 exception(s), 2 definition(s). Coverage state: evidence_found. {scoring.CLOSING}"
    assert row.open_questions == []


def test_passage_recall(spark):
    pairs = spark.createDataFrame([(1, 10, "one two"), (1, 10, "one two"), (2, 10, ""), (3, 11, None)], "gold_id int, claim_id int, constraint string")
    gold = spark.createDataFrame([(1, "a b c d"), (2, "a a"), (3, "a")], "gold_id int, text string")
    passages = spark.createDataFrame([(10, "A b"), (10, "b, one"), (10, None)], "claim_id int, text string")
    found = review.passage_recall(pairs, gold, passages)
    assert sorted(map(tuple, found.collect())) == [(1, 10, 0.5, 0.5), (2, 10, 1.0, 0.0), (3, 11, 0.0, 0.0)]
    assert tuple(review.mean_recall(found).first()) == (0.5, pytest.approx(1 / 6), 3)
    assert tuple(review.mean_recall(found.where("false")).first()) == (0.0, 0.0, 0)


def test_costs_under_both_tables(spark):
    rows = [(" OCR", 2, 1.0, "", 10, None, None, None), ("ocr", 1, 2.0, None, 5, None, None, None), ("ocr", 3, None, "t", 0, None, None, None), ("llm", 1, 1.0, "q", None, None, 80000, 6000), ("other", 1, 4.0, None, 9, 9, 9, 9)]
    events = spark.createDataFrame(rows, "component string, at int, seconds double, engine string, pages long, tokens long, input_tokens long, output_tokens long")
    found = {r.component: r for r in costs.component_costs(events).collect()}
    assert (found["ocr"].events, found["ocr"].seconds, found["ocr"].engine) == (3, 3.0, "t")
    assert found["ocr"].cost_usd == pytest.approx(0.0225) and found["llm"].cost_usd == pytest.approx(0.0156)
    assert found["other"].cost_usd == 0 and found["other"].seconds == 4.0 and all(r.cost_usd_open_weight == 0 for r in found.values())


def test_grid_in_natural_order(spark):
    cells = spark.createDataFrame([("A", "6.10", 1), ("A", "6.9", 2), ("B", "10.1", 3), ("B", None, 4)], "j string, i string, n int")
    found = review.grid(cells, "j", "i", F.sum("n")).orderBy("j")
    assert found.columns == ["j", "6.9", "6.10", "10.1"] and [tuple(r) for r in found.collect()] == [("A", 2, 1, None), ("B", None, None, 3)]
