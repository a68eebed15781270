"""Queries over checked rows: broken rules, expected types with defaults, keyed merges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evigrain.plans.registry import query
from evigrain.sources import checks
from evigrain.sources.staging import shared_dir

RULES = [
    ("doc_id", "required", None),
    ("text", "required", None),
    ("text", "pattern", r"[.!?»)\"'”]\s*$"),
    ("lang", "one_of", ["de", "en", "fr"]),
    ("source", "pattern", "^src[0-9]$"),
    ("n_chars", "at_least", 80),
    ("n_chars", "at_most", 20000),
    ("text", "unique", None),
]


@query(r"""SELECT doc_id, 'text' AS path, 'missing' AS message FROM documents WHERE coalesce(trim(text), '') = ''
UNION ALL SELECT doc_id, 'text', 'malformed: ' || text FROM documents WHERE NOT regexp_matches(text, '[.!?»)"''”]\s*$')
UNION ALL SELECT doc_id, 'lang', 'not allowed: ' || lang FROM documents WHERE lang NOT IN ('de', 'en', 'fr')
UNION ALL SELECT doc_id, 'source', 'malformed: ' || source FROM documents WHERE NOT regexp_matches(source, '^src[0-9]$')
UNION ALL SELECT doc_id, 'n_chars', 'too small: ' || n_chars FROM documents WHERE n_chars < 80
UNION ALL SELECT doc_id, 'n_chars', 'too large: ' || n_chars FROM documents WHERE n_chars > 20000
UNION ALL SELECT doc_id, 'text', 'repeated' FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r > 1""")
def schema_violations(table):
    """A row for each rule that a document breaks."""
    return checks.violations(table("documents"), ["doc_id"], RULES)


@query("""WITH c AS (SELECT DISTINCT lang, source FROM documents), m AS (SELECT DISTINCT lang, source, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS kind FROM documents JOIN labels USING (doc_id) WHERE n_chars > 2000),
g AS (SELECT DISTINCT lang, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'other' END AS kind FROM documents JOIN labels USING (doc_id) WHERE lang <> 'de')
SELECT lang AS jurisdiction, source AS indicator, kind AS document_type, 'indicator' AS given FROM m UNION ALL SELECT c.lang, c.source, g.kind, 'jurisdiction' FROM (SELECT * FROM c ANTI JOIN m USING (lang, source)) c JOIN g USING (lang)
UNION ALL SELECT lang, source, unnest(['statute', 'regulation']), 'default' FROM (SELECT * FROM c ANTI JOIN m USING (lang, source)) ANTI JOIN g USING (lang)""")
def manifest_expectations(table):
    """Kinds of labelled documents that each language and source is expected to hold: its own long ones, else those of its language, else the default."""
    docs = table("documents").withColumnsRenamed({"lang": "jurisdiction", "source": "indicator"})
    labelled = docs.join(table("labels"), "doc_id")
    kind = F.when(F.col("toxic") == 1, "toxic")
    own = labelled.where("n_chars > 2000").select("jurisdiction", "indicator", kind.when(F.col("quality") == 1, "good").otherwise("poor").alias("document_type"))
    general = labelled.where("jurisdiction <> 'de'").select("jurisdiction", F.lit(None).cast("string").alias("indicator"), kind.otherwise("other").alias("document_type"))
    return checks.expected_types(docs, own.unionByName(general).distinct())


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, count(*) AS events FROM events GROUP BY user_id, event_type")
def keyed_merge(table):
    """The last event of each user and type, from a table into which the events come in three merges, each sent twice."""
    events = table("events")
    path = f"{shared_dir(events.sparkSession)}/keyed-{uuid.uuid4().hex}"
    share = F.when(F.col("event_type") == "view", 0).when(F.col("event_type").isin("click", "error"), 1).otherwise(2)
    counts = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("events"))
    rows = events.select("user_id", "event_type", "event_id", "value", share.alias("batch"))
    for batch in (0, 1, 2, 2):
        # A later batch brings the rows of the types before it again, as a full snapshot does.
        merged = checks.merge_keyed(rows.where(F.col("batch") <= batch).drop("batch"), path, ["user_id", "event_type"], ["event_id"], f"batch {batch}")
    return merged.join(counts, ["user_id", "event_type"])
