"""Rules over claims and blocks, on cases written out by hand."""

from pyspark.sql import functions as F

from evigrain.operators import blocks, review


def one(spark, column, **values):
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return frame.select(column.alias("x")).first().x


def test_blocks_headings_and_parts(spark):
    text = "CHAPTER IV\nRights\n\n  \nSec. 26 Access\n(1) first\n  wrapped\n(a) second\n\nplain"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = blocks.text_blocks(docs)
    rows = found.withColumn("heading", blocks.heading_class(F.col("text"))).orderBy("block").collect()
    assert [text[r.char_start : r.char_end] == r.text for r in rows] == [True] * 3
    assert [r.heading for r in rows] == ["chapter", "section", None]
    parts = blocks.sub_paragraphs(found).orderBy("block", "part").collect()
    assert [r.text for r in parts if r.block == 1] == ["Sec. 26 Access", "(1) first\n  wrapped", "(a) second"]


def test_statuses_and_routing(spark):
    rows = [(1, "p", "verified", 0.4), (2, "p", "verified", 0.9), (3, "p", "rejected", 0.1), (4, "q", "verified", None), (5, "r", "verified", 0.1), (6, "s", "verified", None)]
    claims = spark.createDataFrame(rows, "claim_id long, pillar_id string, status string, confidence double")
    screens = spark.createDataFrame([("p", 0.5, True, False), ("q", 0.5, True, False), ("s", None, False, False)], "pillar_id string, threshold double, usable boolean, insufficient boolean")
    got = {r.claim_id: (r.status, r.reason) for r in review.routed(claims, screens).collect()}
    assert got[1] == ("flagged", "model confidence 0.400 below validated threshold 0.500")
    assert got[2] == ("verified", None) and got[3] == ("rejected", None) and got[5] == ("verified", None)
    assert got[4] == ("flagged", "model confidence missing — routed to review") and got[6][1].startswith("confidence not screened")
    decisions = spark.createDataFrame([(1, "ACCEPT"), (2, "reject"), (1, "accept")], "claim_id long, verdict string")
    flagged = claims.withColumn("status", F.lit("flagged"))
    assert {r.claim_id for r in review.promoted(flagged, decisions).where("status = 'verified'").collect()} == {1}
    assert review.exported(claims.withColumn("status", F.when(F.col("claim_id") > 2, F.col("status")))).count() == 5
    assert review.matching(claims, pillar_id="p", status=None).count() == 3 and review.qualifying(claims).count() == 5
    assert one(spark, review.demoted(F.col("s"), F.lit(False)), s="verified") == "flagged" and one(spark, review.demoted(F.col("s"), F.lit(False)), s="rejected") == "rejected"
    assert one(spark, review.layer1_status(F.lit(True), F.lit(False))) == "pending_verification"


def test_texts_and_spans(spark):
    sentence = review.decomposition_sentence(*map(F.col, "abcd"))
    assert one(spark, sentence, a="The controller", b="asked", c="erase data", d="Art. 17") == "The controller when asked must erase data (context: Art. 17)."
    assert one(spark, sentence, a="It", b="", c="stop.", d="") == "It must stop."
    spans = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(r).alias("role")) for i, r in enumerate(("context", "primary", "primary"))))
    assert one(spark, review.primary_span(spans)["id"]) == 1 and one(spark, review.primary_span(F.slice(spans, 1, 1))["id"]) == 0
    both = review.contained_either_way(F.col("a"), F.col("b"))
    assert one(spark, both, a="A  b\nC", b="b c") and one(spark, both, a="b", b="a b c") and not one(spark, both, a="", b="x") and not one(spark, both, a="x", b="y")
    assert one(spark, review.no_evidence_reason(F.lit(0.82))) == "no clauses passed verification; recall=0.82, miss risk ~18% based on gold-set recall"
    assert one(spark, review.pillar_of(F.col("i")), i="6.2") == "6" and one(spark, review.pillar_of(F.col("i")), i="x") == "x"
    assert one(spark, review.band_number(F.lit("0.5"))) == 0.5 and one(spark, review.risk_rank(F.lit("other"))) == 99


def test_scores(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None), (None, "a"), ("b", "b")], "gold string, predicted string")
    got = {r.indicator_id: (r.tp, r.fp, r.fn, r.support) for r in review.indicator_breakdown(pairs).collect()}
    assert got == {"a": (1, 1, 1, 2), "b": (1, 1, 1, 2)}
    assert pairs.agg(review.error_rate(F.col("predicted"), F.col("gold")).alias("x")).first().x == 1 / 3
    share = review.covered_share(F.array(*map(F.lit, "abcd")), F.array(F.lit("a"), F.lit("z")))
    assert one(spark, share) == 0.25 and one(spark, review.covered_share(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0.0
    examples = spark.createDataFrame([(0, "", "0", "red green"), (1, "i", "1", "red green"), (2, "", "null", "blue")], "ord int, label string, band string, text string")
    claims = spark.createDataFrame([(1, "i", "red green"), (2, "j", "blue"), (3, "j", "")], "claim_id long, indicator_id string, text string")
    assert {r.claim_id: r.band for r in review.few_shot_bands(claims, examples).collect()} == {1: "0", 2: None, 3: None}


def test_retrieval(spark):
    rows = [("q", i, 100.0 - i, "eu" if i % 2 else None, float(i)) for i in range(40)]
    hits = spark.createDataFrame(rows, "query_id string, id long, score double, jurisdiction string, other double")
    got = review.retrieved(hits, spark.createDataFrame([("q", "us")], "query_id string, jurisdiction string"), F.col("other"), first=5, keep=3, top_k=2).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in got] == [(8, 1), (6, 2)]  # 0, 2, 4, 6 and 8 are left after the filter
    same = review.retrieved(hits, spark.createDataFrame([("q", None)], "query_id string, jurisdiction string"), review.identity_rerank(F.col("place")), first=5, top_k=2)
    assert [r.id for r in same.orderBy("rank").collect()] == [0, 1]
