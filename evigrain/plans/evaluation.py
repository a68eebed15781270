"""Queries that evaluate and account: labels, gold matching, recall, confidence, cost, roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evigrain.functions import text as T
from evigrain.operators import matching, relational
from evigrain.plans.registry import query

JUDGED_SQL = "j AS (SELECT d.doc_id, d.lang, CAST(l.quality AS VARCHAR) AS truth, CASE WHEN d.n_chars >= 200 AND NOT contains(d.text, '%%%') AND NOT contains(d.text, ' | ') THEN '1' ELSE '0' END AS predicted, least(1.0, d.n_chars / 4000.0) AS confidence FROM documents d JOIN labels l USING (doc_id))"


def _judged(table):
    """Labelled documents with a rule's verdict and a made-up confidence."""
    good = (F.col("n_chars") >= 200) & ~F.contains("text", F.lit("%%%")) & ~F.contains("text", F.lit(" | "))
    docs = table("documents").join(table("labels"), "doc_id")
    return docs.select("doc_id", "lang", F.col("quality").cast("string").alias("truth"), F.when(good, "1").otherwise("0").alias("predicted"), F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("confidence"))


PRF_SQL = JUDGED_SQL + """, r AS (SELECT truth AS label, CASE WHEN truth = predicted THEN 'tp' ELSE 'fn' END AS role FROM j UNION ALL SELECT predicted, 'fp' FROM j WHERE truth <> predicted),
c AS (SELECT label, count(*) FILTER (role = 'tp') AS tp, count(*) FILTER (role = 'fp') AS fp, count(*) FILTER (role = 'fn') AS fn FROM r GROUP BY label),
p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM p)"""


@query("WITH " + PRF_SQL + " SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def prf_quality(table):
    found = relational.precision_recall(_judged(table), "truth", "predicted")
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("WITH " + PRF_SQL + " SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, count(*) AS labels FROM f")
def macro_prf(table):
    found = relational.precision_recall(_judged(table), "truth", "predicted")
    return found.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")), F.count(F.lit(1)).alias("labels"))


@query("WITH " + JUDGED_SQL + " SELECT lang, truth, predicted, count(*) AS n FROM j GROUP BY ALL")
def confusion_quality(table):
    return _judged(table).groupBy("lang", "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + JUDGED_SQL + """, s AS (SELECT lang, count(*) AS pairs, avg(confidence) FILTER (truth = predicted) AS right_mean, avg(confidence) FILTER (truth <> predicted) AS wrong_mean FROM j GROUP BY lang)
SELECT lang, pairs, round(right_mean, 6) AS right_mean, round(wrong_mean, 6) AS wrong_mean, CASE WHEN pairs < 3 OR right_mean IS NULL OR wrong_mean IS NULL THEN 'insufficient' WHEN right_mean - wrong_mean >= 0.15 THEN 'usable' ELSE 'unusable' END AS verdict, round(CASE WHEN right_mean - wrong_mean >= 0.15 AND pairs >= 3 THEN (right_mean + wrong_mean) / 2 END, 6) AS threshold FROM s""")
def confidence_screen(table):
    """Does confidence tell right from wrong verdicts, by language, and at which threshold."""
    right = F.col("truth") == F.col("predicted")
    found = _judged(table).groupBy("lang").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.when(right, F.col("confidence"))).alias("r"), F.avg(F.when(~right, F.col("confidence"))).alias("w"))
    gap = F.col("r") - F.col("w")
    verdict = F.when((F.col("pairs") < 3) | gap.isNull(), "insufficient").when(gap >= 0.15, "usable").otherwise("unusable")
    return found.select("lang", "pairs", F.round("r", 6).alias("right_mean"), F.round("w", 6).alias("wrong_mean"), verdict.alias("verdict"), F.round(F.when(verdict == "usable", (F.col("r") + F.col("w")) / 2), 6).alias("threshold"))


@query("WITH " + JUDGED_SQL + """, d AS (SELECT j.*, source FROM j JOIN documents USING (doc_id)), s AS (SELECT source, avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS size FROM d GROUP BY source)
SELECT round(coalesce(greatest(0, least(1, sum(recall * size) / nullif(sum(size), 0))), 0), 6) AS recall, CAST(sum(size) AS BIGINT) AS size FROM s""")
def weighted_recall(table):
    docs = _judged(table).join(table("documents").select("doc_id", "source"), "doc_id")
    by_source = docs.groupBy("source").agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("recall"), F.count(F.lit(1)).alias("size"))
    mean = F.try_divide(F.sum(F.col("recall") * F.col("size")), F.sum("size"))
    return by_source.agg(F.round(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)), F.lit(0.0)), 6).alias("recall"), F.sum("size").alias("size"))


@query("""WITH g AS (SELECT lang AS jurisdiction, source AS indicator, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn, doc_id AS gold_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
p AS (SELECT lang AS jurisdiction, source AS indicator, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn, doc_id AS predicted_id, n_chars > 1500 AS verbatim FROM documents WHERE n_chars > 1000)
SELECT coalesce(g.jurisdiction, p.jurisdiction) AS jurisdiction, coalesce(g.indicator, p.indicator) AS indicator, count(gold_id) AS gold, count(predicted_id) AS predicted, count(*) FILTER (gold_id IS NOT NULL AND predicted_id IS NOT NULL) AS matched, count(*) FILTER (gold_id IS NOT NULL AND verbatim) AS faithful FROM g FULL JOIN p ON g.jurisdiction = p.jurisdiction AND g.indicator = p.indicator AND g.rn = p.rn GROUP BY ALL""")
def gold_match(table):
    """One-to-one matches of predictions and gold rows with equal keys, in order, and what they score."""
    docs = table("documents").withColumnsRenamed({"lang": "jurisdiction", "source": "indicator"})
    cell = ["jurisdiction", "indicator"]
    gold = relational.ranked(docs.join(table("labels").where("quality = 1"), "doc_id", "left_semi"), cell, "doc_id", "rn").select(*cell, "rn", F.lit(True).alias("gold"))
    predicted = relational.ranked(docs.where("n_chars > 1000"), cell, "doc_id", "rn").select(*cell, "rn", F.lit(True).alias("predicted"), (F.col("n_chars") > 1500).alias("verbatim"))
    both = gold.join(predicted, ["jurisdiction", "indicator", "rn"], "full_outer")
    return both.groupBy("jurisdiction", "indicator").agg(F.count("gold").alias("gold"), F.count("predicted").alias("predicted"), F.count_if(F.col("gold") & F.col("predicted")).alias("matched"), F.count_if(F.col("gold") & F.col("verbatim")).alias("faithful"))


@query("""WITH d AS (SELECT doc_id, lang, source, coalesce(quality = 1, false) AS gold, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS s FROM documents LEFT JOIN labels USING (doc_id)),
k AS (SELECT * FROM d WHERE gold), m AS (SELECT DISTINCT n.doc_id FROM d n JOIN k ON n.lang = k.lang AND n.source = k.source AND len(n.s) > 0 AND len(k.s) > 0 AND len(n.s) >= 0.6 * len(k.s) AND len(k.s) >= 0.6 * len(n.s) AND len(list_intersect(n.s, k.s)) >= 0.6 * len(list_distinct(list_concat(n.s, k.s))))
SELECT doc_id, CASE WHEN gold OR m.doc_id IS NOT NULL THEN 'KNOWN' ELSE 'NEW' END AS tag FROM d LEFT JOIN m USING (doc_id)""")
def discovery_tag(table):
    """KNOWN if the document itself is registered (well labelled), or its words overlap by 0.6 or more with a registered document of its language and source."""
    docs = table("documents").select("doc_id", "lang", "source", "text")
    gold = table("labels").where("quality = 1").select("doc_id").distinct()
    return matching.discovery_tags(docs, gold, ["lang", "source"], 0.6, T.tokens(F.col("text")))


@query("""WITH g AS (SELECT DISTINCT b.item_id, lower(d.lang) AS lang, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), r AS (SELECT item_id, lang, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM g)
SELECT lang, count(*) AS items, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1 FROM r GROUP BY lang""")
def multilingual_recall(table):
    pairs = relational.containing(table("documents"), "doc_id", table("benchmark"), "item_id").join(table("documents").select("doc_id", F.lower("lang").alias("lang")), "doc_id").distinct()
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id")))
    return ranked.groupBy("lang").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg((F.col("rank") <= 1).cast("double")), 6).alias("recall_at_1"))


@query("""SELECT event_type AS kind, count(*) AS calls, round(sum(value), 4) AS seconds, round(sum(value) / 60, 4) AS minutes, round(sum(value) / count(DISTINCT user_id), 4) AS per_claim FROM events GROUP BY event_type""")
def cost_summary(table):
    rows = table("events").groupBy(F.col("event_type").alias("kind"))
    return rows.agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("seconds"), F.round(F.sum("value") / 60, 4).alias("minutes"), F.round(F.sum("value") / F.countDistinct("user_id"), 4).alias("per_claim"))


@query("""WITH a AS (SELECT event_type AS metric, avg(value) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS metric, avg(value) AS v FROM events WHERE user_id % 2 = 1 GROUP BY 1) SELECT metric, round(a.v, 6) AS base, round(b.v, 6) AS variant, round(b.v - a.v, 6) AS delta FROM a JOIN b USING (metric)""")
def ablation(table):
    """A metric with and without a variant, here the two halves of the users."""
    half = lambda r: table("events").where(F.col("user_id") % 2 == r).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias(f"v{r}"))
    return half(0).join(half(1), "metric").select("metric", F.round("v0", 6).alias("base"), F.round("v1", 6).alias("variant"), F.round(F.col("v1") - F.col("v0"), 6).alias("delta"))


@query("""SELECT r_name, o_orderstatus, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def pillar_rollup(table):
    rows = table("lineitem").join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


@query("""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM benchmark), k(lang, ord, kw) AS (VALUES ('en', 0, 'the'), ('en', 1, 'transfer'), ('fr', 0, 'données'), ('fr', 1, 'transfer'), ('de', 0, 'der')),
n AS (SELECT item_id, lang, ord, kw, row_number() OVER (PARTITION BY item_id, kw ORDER BY lang, ord) AS r FROM q, k WHERE NOT list_contains(w, kw)) SELECT item_id, string_agg(kw, ' ' ORDER BY lang, ord) AS added FROM n WHERE r = 1 GROUP BY item_id""")
def query_expansion(table):
    """Keywords of all languages, in order, that a query doesn't have, each once."""
    words = table("region").sparkSession.createDataFrame([("en", 0, "the"), ("en", 1, "transfer"), ("fr", 0, "données"), ("fr", 1, "transfer"), ("de", 0, "der")], "lang string, ord int, kw string")
    first = relational.latest(words, ["kw"], [F.asc("lang"), F.asc("ord")])
    asked = table("benchmark").select("item_id", T.tokens(F.col("text")).alias("w")).crossJoin(F.broadcast(first)).where(~F.array_contains("w", F.col("kw")))
    parts = F.array_sort(F.collect_list(F.struct("lang", "ord", "kw")))
    return asked.groupBy("item_id").agg(F.array_join(F.transform(parts, lambda x: x["kw"]), " ").alias("added"))


@query("""WITH s AS (SELECT e.user_id, e.event_id, e.ts, lag(e.ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events e), k AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch(ts) - epoch(before) > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events FROM k GROUP BY ALL""")
def run_sessions(table):
    """Runs of a user's events no more than twelve hours apart."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table("events").select("user_id", "event_id", "ts", at.alias("at"))
    fresh = F.when(F.lag("at").over(order).isNull() | (F.col("at") - F.lag("at").over(order) > 43200), 1).otherwise(0)
    return rows.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(order)).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"))
