"""Queries over blocks of statutes, claims under review, the second layer, gold scores and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain.functions import text as T
from evigrain.operators import blocks, review
from evigrain.plans.registry import query

STATUTES_SQL = r"""SELECT doc_id, list_aggregate(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 5 = 1 THEN 'Section ' || i || chr(10) || x WHEN i % 5 = 2 THEN chr(10) || '(' || i || ') ' || x WHEN i % 5 = 3 THEN '  (a) ' || x WHEN i % 5 = 4 THEN 'and ' || x ELSE x || chr(10) || ' ' END), 'string_agg', chr(10)) AS text FROM documents"""
BLOCKS_SQL = r"""p AS (SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n')) AS text, unnest(list_append(list_transform(regexp_extract_all(text, '\n\s*\n'), lambda x: length(x)), 0)) AS gap, generate_subscripts(string_split_regex(text, '\n\s*\n'), 1) AS pos FROM t),
o AS (SELECT *, sum(length(text) + gap) OVER (PARTITION BY doc_id ORDER BY pos) - length(text) - gap AS char_start FROM p),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block, CAST(char_start AS INT) AS char_start, CAST(char_start + length(text) AS INT) AS char_end, text FROM o WHERE regexp_matches(text, '\S'))"""


def _statutes(table):
    """The documents' lines set out as sections and numbered sub-paragraphs."""
    n = lambda i: (i + 1).cast("string")
    laid = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("Section "), n(i), F.lit("\n"), x)).when(i % 5 == 1, F.concat(F.lit("\n("), n(i), F.lit(") "), x))
        .when(i % 5 == 2, F.concat(F.lit("  (a) "), x)).when(i % 5 == 3, F.concat(F.lit("and "), x)).otherwise(F.concat(x, F.lit("\n "))),
    )
    return table("documents").select("doc_id", F.array_join(laid, "\n").alias("text"))


@query(f"""WITH t AS ({STATUTES_SQL}), {BLOCKS_SQL}
SELECT doc_id, block, char_start, char_end, md5(text) AS digest, CASE WHEN regexp_matches(trim(string_split(text, chr(10))[1]), '(?i)^section\\s+\\d+') THEN 'section' ELSE '-' END AS heading FROM b""")
def statute_blocks(table):
    found = blocks.text_blocks(_statutes(table))
    return found.select("doc_id", "block", "char_start", "char_end", F.md5(F.col("text").cast("binary")).alias("digest"), F.coalesce(blocks.heading_class(F.col("text")), F.lit("-")).alias("heading"))


@query(rf"""WITH t AS ({STATUTES_SQL}), {BLOCKS_SQL},
l AS (SELECT doc_id, block, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM b),
g AS (SELECT *, sum(CASE WHEN pos > 1 AND regexp_matches(line, '^\s*\((\d+|[a-z]+)\)(\s|$)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block ORDER BY pos) AS part FROM l)
SELECT doc_id, block, CAST(part AS BIGINT) AS part, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM g GROUP BY doc_id, block, part""")
def statute_parts(table):
    return blocks.sub_paragraphs(blocks.text_blocks(_statutes(table))).select("doc_id", "block", "part", F.md5(F.col("text").cast("binary")).alias("digest"))


CLAIMS_SQL = r"""SELECT d.doc_id AS claim_id, lang AS jurisdiction, source AS indicator_id, source AS pillar_id, CASE WHEN quality = 0 THEN 'rejected' WHEN toxic = 1 THEN 'flagged' ELSE 'verified' END AS status, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) / len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS confidence FROM documents d JOIN labels USING (doc_id) WHERE len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 0"""


def _claims(table):
    """A claim for each labelled document: its labels give the first layer's status, its share of distinct words a confidence."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    first = review.layer1_status(F.col("quality") == 1, F.col("toxic") == 1)
    status = F.when(first == "pending_verification", "verified").otherwise(first)
    rows = table("documents").join(table("labels"), "doc_id").withColumn("words", words).where(F.size("words") > 0)
    return rows.select(F.col("doc_id").alias("claim_id"), F.col("lang").alias("jurisdiction"), F.col("source").alias("indicator_id"), F.col("source").alias("pillar_id"), status.alias("status"), (F.size(F.array_distinct("words")) / F.size("words")).alias("confidence"))


SCREEN_SQL = "s AS (SELECT pillar_id, avg(confidence) FILTER (status = 'verified') AS threshold, count(*) FILTER (status <> 'rejected') >= 3 AS usable, count(*) < 3 AS insufficient FROM c GROUP BY pillar_id)"


@query(f"""WITH c AS ({CLAIMS_SQL}), {SCREEN_SQL}
SELECT claim_id, CASE WHEN status = 'verified' AND NOT insufficient AND (NOT usable OR confidence < threshold) THEN 'flagged' ELSE status END AS status, status = 'verified' AND NOT insufficient AND (NOT usable OR coalesce(confidence < threshold, false)) AS rerouted FROM c JOIN s USING (pillar_id)""")
def confidence_routing(table):
    """Verified claims below their pillar's mean confidence go to review."""
    claims = _claims(table)
    screens = claims.groupBy("pillar_id").agg(F.avg(F.when(F.col("status") == "verified", F.col("confidence"))).alias("threshold"), (F.count_if(F.col("status") != "rejected") >= 3).alias("usable"), (F.count(F.lit(1)) < 3).alias("insufficient"))
    return review.routed(claims, screens).select("claim_id", "status", F.col("reason").isNotNull().alias("rerouted"))


@query(f"""WITH c AS ({CLAIMS_SQL}) SELECT claim_id, CASE WHEN status = 'flagged' AND claim_id % 2 = 0 THEN 'verified' ELSE status END AS status FROM c WHERE status <> 'rejected'""")
def review_promotion(table):
    """Flagged claims that a reviewer accepts are verified; rejected ones aren't exported."""
    claims = _claims(table)
    decisions = claims.select("claim_id", F.when(F.col("claim_id") % 2 == 0, "Accept").otherwise("reject").alias("verdict"))
    return review.exported(review.promoted(claims, decisions)).select("claim_id", "status")


COVERAGE_SQL = "v AS (SELECT jurisdiction, indicator_id, CASE WHEN count(*) FILTER (status = 'verified') > 0 THEN 'evidence_found' WHEN count(*) >= 2 THEN 'no_evidence_in_searched_corpus' ELSE 'insufficient_coverage' END AS state, count(*) AS claims FROM c GROUP BY jurisdiction, indicator_id)"


def _coverage(claims):
    verified, every = F.count_if(F.col("status") == "verified"), F.count(F.lit(1))
    state = F.when(verified > 0, "evidence_found").when(every >= 2, "no_evidence_in_searched_corpus").otherwise("insufficient_coverage")
    return claims.groupBy("jurisdiction", "indicator_id").agg(state.alias("state"), every.alias("claims"))


@query(f"""WITH c AS ({CLAIMS_SQL}), {COVERAGE_SQL} SELECT jurisdiction, indicator_id, claim_id, state, claims FROM c JOIN v USING (jurisdiction, indicator_id) WHERE status = 'verified'""")
def second_layer(table):
    claims = _claims(table)
    return review.second_layer(claims, _coverage(claims)).select("jurisdiction", "indicator_id", "claim_id", "state", "claims")


@query(f"""WITH c AS (SELECT * FROM ({CLAIMS_SQL}) WHERE claim_id % 3 > 0), {COVERAGE_SQL} SELECT *, row_number() OVER (ORDER BY CASE state WHEN 'insufficient_coverage' THEN 0 WHEN 'no_evidence_in_searched_corpus' THEN 1 ELSE 2 END, indicator_id, jurisdiction) AS place, state = 'insufficient_coverage' AS widen FROM v""")
def coverage_risk(table):
    """Coverage rows by risk, then indicator; which of them ask for wider sources."""
    from pyspark.sql import Window

    rows = _coverage(_claims(table).where("claim_id % 3 > 0"))
    place = F.row_number().over(Window.orderBy(review.risk_rank(F.col("state")), "indicator_id", "jurisdiction"))
    return rows.withColumn("place", place).withColumn("widen", review.needs_wider_sources(F.col("state")))


@query(f"""WITH c AS (SELECT * FROM ({CLAIMS_SQL}) WHERE status <> 'verified' OR claim_id % 4 = 0), {COVERAGE_SQL}, g AS (SELECT DISTINCT jurisdiction, indicator_id FROM ({CLAIMS_SQL}) WHERE status = 'verified'), z AS (SELECT split_part(indicator_id, '.', 1) AS pillar_id, g.jurisdiction IS NOT NULL AS present FROM v LEFT JOIN g USING (jurisdiction, indicator_id) WHERE state = 'no_evidence_in_searched_corpus')
SELECT pillar_id, count(*) AS rows, count(*) FILTER (present) AS false_zeros, count(*) FILTER (present) / count(*) AS rate FROM z GROUP BY pillar_id""")
def false_zeros(table):
    """Pairs for which part of the claims shows no evidence, though all of them together do."""
    claims = _claims(table)
    return review.false_zero_rate(_coverage(claims.where("status <> 'verified' or claim_id % 4 = 0")), review.qualifying(claims))


@query(f"""WITH c AS ({CLAIMS_SQL}), {COVERAGE_SQL} SELECT count(DISTINCT lower(jurisdiction)) AS jurisdictions, count(*) FILTER (state = 'evidence_found') AS found, count(*) FILTER (state = 'no_evidence_in_searched_corpus') AS nothing, count(*) FILTER (state = 'insufficient_coverage') AS insufficient FROM v""")
def coverage_dashboard(table):
    rows, of = _coverage(_claims(table)), lambda s: F.count_if(F.col("state") == s)
    return rows.agg(F.count_distinct(F.lower("jurisdiction")).alias("jurisdictions"), of("evidence_found").alias("found"), of("no_evidence_in_searched_corpus").alias("nothing"), of("insufficient_coverage").alias("insufficient"))


@query("""WITH p AS (SELECT CASE WHEN l_discount > 0 THEN l_returnflag END AS gold, CASE WHEN l_quantity >= 5 THEN CASE l_linestatus WHEN 'F' THEN 'A' ELSE 'N' END END AS predicted FROM lineitem),
r AS (SELECT gold AS i, coalesce(gold = predicted, false) AS ok, 'g' AS role FROM p WHERE gold IS NOT NULL UNION ALL SELECT predicted, false, 'p' FROM p WHERE predicted IS NOT NULL AND NOT coalesce(gold = predicted, false)),
s AS (SELECT i AS indicator_id, count(*) FILTER (ok) AS tp, count(*) FILTER (role = 'p') AS fp, count(*) FILTER (role = 'g' AND NOT ok) AS fn FROM r GROUP BY i),
q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM s)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, tp + fn AS support FROM q""")
def indicator_breakdown(table):
    gold, predicted = F.when(F.col("l_discount") > 0, F.col("l_returnflag")), F.when(F.col("l_quantity") >= 5, F.when(F.col("l_linestatus") == "F", "A").otherwise("N"))
    return review.indicator_breakdown(table("lineitem").select(gold.alias("gold"), predicted.alias("predicted")))


WORDS_SQL = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"


@query(f"""WITH e AS (SELECT item_id AS ord, CASE item_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '0.5' WHEN 2 THEN '1' END AS band, {WORDS_SQL} AS w FROM benchmark WHERE item_id < 16), c AS (SELECT doc_id AS claim_id, {WORDS_SQL} AS w FROM documents),
m AS (SELECT claim_id, band, len(list_intersect(c.w, e.w)) / len(list_distinct(c.w || e.w)) AS overlap, ord FROM c, e WHERE band IS NOT NULL AND len(c.w) > 0 AND len(e.w) > 0),
b AS (SELECT claim_id, arg_max(band, (overlap, -ord)) AS band, max(overlap) AS overlap FROM m WHERE overlap > 0 GROUP BY claim_id)
SELECT c.claim_id, CASE WHEN overlap >= 0.15 THEN band ELSE '-' END AS band, coalesce(overlap, 0) AS overlap FROM c LEFT JOIN b USING (claim_id)""")
def few_shot_bands(table):
    """The band of the most similar example, of a few configured ones, for every document."""
    band = F.when(F.col("item_id") % 4 == 0, "0").when(F.col("item_id") % 4 == 1, "0.5").when(F.col("item_id") % 4 == 2, "1")
    examples = table("benchmark").where("item_id < 16").select(F.col("item_id").alias("ord"), F.lit("").alias("label"), band.alias("band"), "text")
    claims = table("documents").select(F.col("doc_id").alias("claim_id"), F.col("source").alias("indicator_id"), "text")
    return review.few_shot_bands(claims, examples).withColumn("band", F.coalesce("band", F.lit("-")))


@query("""WITH h AS (SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS score, l_returnflag AS jurisdiction, l_quantity FROM lineitem),
w AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'R' END AS asked FROM supplier),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM h), g AS (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY score DESC, id) AS p FROM f JOIN w USING (query_id) WHERE place <= 160 AND (asked IS NULL OR asked = jurisdiction)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY l_quantity DESC, p) AS rank FROM g WHERE p <= 40)
SELECT query_id, id, score, l_quantity::DOUBLE AS rerank_score, rank FROM r WHERE rank <= 8""")
def retrieve_and_rerank(table):
    """Over-fetched hits of every query, filtered by jurisdiction, the best of them sorted again."""
    hits = table("lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("score"), F.col("l_returnflag").alias("jurisdiction"), "l_quantity")
    asked = F.when(F.col("s_suppkey") % 3 == 0, "N").when(F.col("s_suppkey") % 3 == 1, "R")
    return review.retrieved(hits, table("supplier").select(F.col("s_suppkey").alias("query_id"), asked.alias("jurisdiction")), F.col("l_quantity"))
