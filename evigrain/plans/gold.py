"""Queries that match predictions with gold rows: by provision, by tiers of preference, and what the matches score."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain.operators import matching, relational
from evigrain.plans.registry import query

#: Well labelled documents are gold provisions, long documents are predictions; forty neighbouring ids are one law.
SIDES_SQL = """g AS (SELECT doc_id AS id, lang AS jurisdiction, source AS indicator, 'Law-' || (doc_id // 40) AS doc, CAST(1 - toxic AS VARCHAR) AS band, CASE WHEN n_chars > 2000 THEN 'A' ELSE 'B' END AS tier, string_split(text, chr(10))[1] AS span FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
p AS (SELECT doc_id AS id, upper(lang) || ' ' AS jurisdiction, source AS indicator, 'LAW ' || (doc_id // 40) AS doc, CASE WHEN contains(text, ' | ') THEN '0' ELSE '1' END AS band, CASE WHEN n_chars > 1500 THEN 'A' ELSE 'B' END AS tier, text AS span, CASE WHEN contains(text, '%%%') THEN 'NEW' ELSE 'KNOWN' END AS tag FROM documents WHERE n_chars > 1000)"""
FOLD_SQL = "replace(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), 'ß', 'ss')"
KEY_SQL = f"SELECT *, {FOLD_SQL.format('jurisdiction')} AS kj, trim(indicator) AS ki, regexp_replace({FOLD_SQL.format('doc')}, '[^a-z0-9]', '', 'g') AS kd FROM {{0}}"
OUTCOME_SQL = f"""{SIDES_SQL}, gk AS (SELECT *, row_number() OVER (PARTITION BY kj, ki, kd ORDER BY id) AS r FROM ({KEY_SQL.format('g')})), pk AS (SELECT *, row_number() OVER (PARTITION BY kj, ki, kd ORDER BY id) AS r FROM ({KEY_SQL.format('p')})),
m AS (SELECT gk.id AS gold_id, pk.id AS predicted_id, coalesce(gk.indicator, pk.indicator) AS indicator, gk.indicator AS gi, pk.indicator AS pi, gk.band AS gb, gk.indicator = pk.indicator AS si, gk.band = pk.band AS sb, gk.tier = pk.tier AS st,
{FOLD_SQL.format('gk.span')} <> '' AND (contains({FOLD_SQL.format('pk.span')}, {FOLD_SQL.format('gk.span')}) OR contains({FOLD_SQL.format('gk.span')}, {FOLD_SQL.format('pk.span')})) AS verbatim,
CASE WHEN gk.id IS NOT NULL AND pk.id IS NOT NULL THEN 'matched' WHEN gk.id IS NOT NULL THEN 'missed' WHEN tag = 'NEW' THEN 'new' ELSE 'spurious' END AS kind FROM gk FULL JOIN pk ON gk.kj = pk.kj AND gk.ki = pk.ki AND gk.kd = pk.kd AND gk.r = pk.r)"""
SCORES_SQL = """round(coalesce(count(*) FILTER (kind = 'matched' AND si AND sb AND st) / nullif(count(*) FILTER (kind = 'matched'), 0), 0), 6) AS field_accuracy, round(coalesce(count(*) FILTER (kind = 'matched' AND si) / nullif(count(*) FILTER (kind = 'matched'), 0), 0), 6) AS indicator_accuracy,
round(coalesce(count(*) FILTER (kind = 'matched' AND sb) / nullif(count(*) FILTER (kind = 'matched'), 0), 0), 6) AS band_accuracy, round(coalesce(count(*) FILTER (kind = 'matched' AND st) / nullif(count(*) FILTER (kind = 'matched'), 0), 0), 6) AS tier_accuracy,
round(coalesce(count(*) FILTER (kind = 'matched' AND verbatim) / nullif(count(*) FILTER (kind = 'matched'), 0), 0), 6) AS citation_fidelity, round(coalesce(count(*) FILTER (kind = 'missed' AND gb <> '0') / nullif(count(*) FILTER (gb <> '0'), 0), 0), 6) AS false_zero_rate,
count(*) FILTER (kind = 'matched') AS tp, count(*) FILTER (kind = 'missed') AS fn, count(*) FILTER (kind = 'spurious') AS fp, count(*) FILTER (kind = 'new') AS discovery_new, count(gold_id) AS gold_total, count(predicted_id) AS predicted_total"""


def _sides(table):
    docs = table("documents")
    law = lambda name: F.concat(F.lit(name), F.floor(F.col("doc_id") / 40).cast("string")).alias("doc")
    tier = lambda n: F.when(F.col("n_chars") > n, "A").otherwise("B").alias("tier")
    first = F.get(F.split("text", "\n", 2), F.lit(0)).alias("span")
    gold = docs.join(table("labels").where("quality = 1"), "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("jurisdiction"), F.col("source").alias("indicator"), law("Law-"), (1 - F.col("toxic")).cast("string").alias("band"), tier(2000), first)
    band = F.when(F.contains("text", F.lit(" | ")), "0").otherwise("1").alias("band")
    tag = F.when(F.contains("text", F.lit("%%%")), "NEW").otherwise("KNOWN").alias("tag")
    predicted = docs.where("n_chars > 1000").select(F.col("doc_id").alias("id"), F.concat(F.upper("lang"), F.lit(" ")).alias("jurisdiction"), F.col("source").alias("indicator"), law("LAW "), band, tier(1500), F.col("text").alias("span"), tag)
    return gold, predicted


def _outcomes(table):
    gold, predicted = _sides(table)
    return matching.outcomes(gold, predicted, matching.same_provision(gold, predicted))


def _rounded(scores):
    return scores.withColumns({c: F.round(c, 6) for c in scores.columns if c.endswith(("accuracy", "fidelity", "rate"))})


@query(f"WITH {OUTCOME_SQL} SELECT {SCORES_SQL} FROM m")
def gold_scores(table):
    """Predictions against gold provisions, each used once: accuracies of fields, fidelity of citations, false zeros, counts."""
    return _rounded(matching.scores(_outcomes(table)))


@query(f"WITH {OUTCOME_SQL} SELECT indicator AS pillar, {SCORES_SQL} FROM m GROUP BY indicator")
def pillar_scores(table):
    """The same by pillar."""
    pillar = F.coalesce(F.col("gold.indicator"), F.col("predicted.indicator")).alias("pillar")
    return _rounded(matching.scores(_outcomes(table), [pillar]))


@query(f"""WITH {OUTCOME_SQL}, y AS (SELECT coalesce(gi, '<no_claim>') AS t, coalesce(pi, '<no_claim>') AS q FROM m WHERE kind <> 'new'), r AS (SELECT t AS label, CASE WHEN t = q THEN 'tp' ELSE 'fn' END AS role FROM y UNION ALL SELECT q, 'fp' FROM y WHERE t <> q),
c AS (SELECT label, count(*) FILTER (role = 'tp') AS tp, count(*) FILTER (role = 'fp') AS fp, count(*) FILTER (role = 'fn') AS fn FROM r GROUP BY label), f AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM f""")
def gold_labels(table):
    """Precision and recall of each indicator over provisions, a missing side with a label of its own."""
    found = relational.precision_recall(matching.labelled(_outcomes(table)), "truth", "predicted")
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def _tiers_sql() -> str:
    ctes = [SIDES_SQL, "g0 AS (SELECT id, jurisdiction, indicator, doc FROM g)", "p0 AS (SELECT id, lower(trim(jurisdiction)) AS jurisdiction, indicator, replace(doc, 'LAW ', 'Law-') AS doc FROM p)"]
    for i, tier in enumerate(matching.TIERS):
        by = ", ".join(tier)
        ctes.append(f"m{i} AS (SELECT a.id AS gold_id, b.id AS claim_id, {i + 1} AS tier FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY id) AS r FROM g{i}) a JOIN (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY id) AS r FROM p{i}) b USING ({by}, r))")
        ctes.append(f"g{i + 1} AS (SELECT * FROM g{i} WHERE id NOT IN (SELECT gold_id FROM m{i}))")
        ctes.append(f"p{i + 1} AS (SELECT * FROM p{i} WHERE id NOT IN (SELECT claim_id FROM m{i}))")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(len(matching.TIERS)))


def _claims(predicted):
    return predicted.select("id", F.lower(F.trim("jurisdiction")).alias("jurisdiction"), "indicator", F.replace("doc", F.lit("LAW "), F.lit("Law-")).alias("doc"))


@query(_tiers_sql())
def best_claims(table):
    """Each gold provision with one claim: of its law and indicator, of its law, of its jurisdiction and indicator, or of its jurisdiction."""
    gold, predicted = _sides(table)
    return matching.best_claims(gold.select("id", "jurisdiction", "indicator", "doc"), _claims(predicted))


@query(f"""WITH {SIDES_SQL}, c AS (SELECT id, lower(trim(jurisdiction)) AS jurisdiction, indicator, replace(doc, 'LAW ', 'Law-') AS doc FROM p)
SELECT g.id AS gold_id, arg_min(c.id, (CASE WHEN c.indicator = g.indicator THEN 0 ELSE 1 END, c.id)) AS claim_id FROM g JOIN c ON g.jurisdiction = c.jurisdiction AND g.doc = c.doc GROUP BY g.id""")
def first_claims(table):
    """The first claim of each gold provision's law, one of its indicator if there is any."""
    gold, predicted = _sides(table)
    return matching.first_claims(gold, _claims(predicted))
