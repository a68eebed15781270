"""Queries over evidence: retrieval, votes, gates, coverage, recommendations, export, review."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evigrain.functions import text as T
from evigrain.operators import nearest, relational, rules
from evigrain.plans.corpus import LINES_SQL
from evigrain.plans.registry import query, sql_list, tokens_sql

#: Indicators of the flagship query: id, name, keywords.
INDICATORS = [("6.1", "transfer of data", ["tion", "data", "ment"]), ("6.2", "licence", ["licen", "apache", "zürich"]), ("7.1", "mandate", ["shall", "ung", "ción"]), ("7.2", "absent", ["qqqq", "zzzzz"])]
INDICATOR_SQL = "(VALUES " + ", ".join(f"('{i}', {sql_list(k)})" for i, _, k in INDICATORS) + ") AS ind(indicator_id, keywords)"
SCORE_SQL = "list_sum(list_transform(keywords, lambda k: (length({0}) - length(replace({0}, k, ''))) // length(k)))"


def _indicators(table):
    spark = table("region").sparkSession
    return spark.createDataFrame([(i, k) for i, _, k in INDICATORS], "indicator_id string, keywords array<string>")


COVERAGE_SQL = f"""WITH l AS ({LINES_SQL}), e AS (SELECT * FROM l WHERE trim(line) <> ''),
s AS (SELECT lang, indicator_id, doc_id, seq, {SCORE_SQL.format('lower(line)')} AS score FROM e, {INDICATOR_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, indicator_id ORDER BY score DESC, doc_id, seq) AS rk FROM s WHERE score > 0),
h AS (SELECT lang, indicator_id, count(*) AS evidence_count, string_agg(doc_id || '_p' || seq, ',' ORDER BY rk) AS evidence_ids FROM r WHERE rk <= 8 GROUP BY ALL),
g AS (SELECT DISTINCT d.lang, d.doc_id, b.item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
k AS (SELECT g.lang, i.indicator_id, avg(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.lang = g.lang AND r.indicator_id = i.indicator_id AND r.doc_id = g.doc_id) THEN 1.0 ELSE 0.0 END) AS recall FROM g, {INDICATOR_SQL.replace('AS ind(', 'AS i(')} GROUP BY ALL),
p AS (SELECT * FROM (SELECT DISTINCT lang FROM documents), {INDICATOR_SQL})
SELECT p.lang, p.indicator_id, CASE WHEN coalesce(h.evidence_count, 0) > 0 THEN 'evidence_found' WHEN k.recall IS NOT NULL THEN 'no_evidence_in_searched_corpus' ELSE 'insufficient_coverage' END AS state,
round(k.recall, 6) AS measured_recall, CAST(round_even((1 - k.recall) * 100, 0) AS INT) AS miss_percent, coalesce(h.evidence_count, 0) AS evidence_count, coalesce(h.evidence_ids, '') AS evidence_ids
FROM p LEFT JOIN h USING (lang, indicator_id) LEFT JOIN k USING (lang, indicator_id)"""


@query(COVERAGE_SQL)
def coverage_3state(table):
    """For each language and indicator: is there evidence, which elements carry it, and what recall backs the answer."""
    docs, items = table("documents"), table("benchmark")
    indicators = _indicators(table)
    hits = rules.keyword_hits(docs, indicators)
    best = relational.top_k(hits, ["lang", "indicator_id"], [F.desc("score"), F.asc("doc_id"), F.asc("seq")], 8)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "element_id"))), lambda x: x["element_id"]), ",")
    evidence = best.groupBy("lang", "indicator_id").agg(F.count(F.lit(1)).alias("evidence_count"), ids.alias("evidence_ids"))
    gold = relational.containing(docs, "doc_id", items, "item_id").join(docs.select("doc_id", "lang"), "doc_id")
    found = hits.select("lang", "indicator_id", "doc_id").distinct().withColumn("hit", F.lit(1.0))
    asked = gold.crossJoin(indicators.select("indicator_id"))
    recall = asked.join(found, ["lang", "indicator_id", "doc_id"], "left").groupBy("lang", "indicator_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
    spine = docs.select("lang").distinct().crossJoin(indicators.select("indicator_id"))
    rows = spine.join(evidence, ["lang", "indicator_id"], "left").join(recall, ["lang", "indicator_id"], "left")
    n = F.coalesce("evidence_count", F.lit(0))
    return rows.select("lang", "indicator_id", rules.coverage_state(n > 0, F.col("recall")).alias("state"), F.round("recall", 6).alias("measured_recall"), rules.miss_percent(F.col("recall")).alias("miss_percent"), n.alias("evidence_count"), F.coalesce("evidence_ids", F.lit("")).alias("evidence_ids"))


@query(f"""WITH s AS (SELECT lang, indicator_id, doc_id, {SCORE_SQL.format('lower(text)')} AS score FROM documents, {INDICATOR_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY indicator_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) SELECT indicator_id, doc_id, CAST(score AS BIGINT) AS score, rank FROM r WHERE rank <= 10""")
def keyword_topk(table):
    docs = table("documents").select("doc_id", F.lower("text").alias("low"))
    met = docs.join(F.broadcast(_indicators(table)), T.has_keyword(F.col("low"), F.col("keywords")))
    scored = met.select("indicator_id", "doc_id", T.keyword_score(F.col("low"), F.col("keywords")).alias("score"))
    return relational.top_k(scored, ["indicator_id"], [F.desc("score"), F.asc("doc_id")], 10)


TERMS_SQL = "SELECT {0}, ('0x' || right(md5(t), 6))::BIGINT AS term, count(*) AS tf FROM (SELECT {0}, unnest({2}) AS t FROM {1}) GROUP BY ALL"
SPARSE_SQL = f"""WITH d AS ({TERMS_SQL.format('doc_id', 'documents', tokens_sql('text', 'lang'))}), q AS ({TERMS_SQL.format('item_id', 'benchmark', tokens_sql('text', "'en'"))}), s AS (SELECT item_id, doc_id, sum(d.tf * q.tf) AS score FROM q JOIN d USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def _sparse_ranks(table, limit: int):
    docs, items = rules.hashed_terms(table("documents"), "doc_id", "lang"), rules.hashed_terms(table("benchmark"), "item_id")
    scores = items.withColumnRenamed("tf", "q").join(docs, "term").groupBy("item_id", "doc_id").agg(F.sum(F.col("q") * F.col("tf")).alias("score"))
    return relational.top_k(scores, ["item_id"], [F.desc("score"), F.asc("doc_id")], limit)


@query(SPARSE_SQL + " SELECT item_id, doc_id, CAST(score AS BIGINT) AS score, rank FROM r WHERE rank <= 10")
def sparse_search(table):
    return _sparse_ranks(table, 10)


EMBED_SQL = """SELECT {0}, list_transform(v, lambda x: x / greatest(1e-12, sqrt(list_sum(list_transform(v, lambda y: y * y))))) AS v FROM (SELECT {0}, list(w ORDER BY b) AS v FROM
(SELECT g.{0}, r.b, coalesce(c.w, 0.0) AS w FROM (SELECT {0} FROM {1}) g CROSS JOIN (SELECT unnest(range(64)) AS b) r LEFT JOIN (SELECT {0}, (('0x' || right(md5(t), 2))::INT % 64)::BIGINT AS b, sum(CASE WHEN ('0x' || substr(md5(t), -6, 2))::INT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0 END) AS w FROM (SELECT {0}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{4,}}')) AS t FROM {1}) GROUP BY ALL) c ON c.{0} = g.{0} AND c.b = r.b) GROUP BY {0})"""
DENSE_SQL = f"""dd AS ({EMBED_SQL.format('doc_id', 'documents')}), dq AS ({EMBED_SQL.format('item_id', 'benchmark')}), ds AS (SELECT item_id, doc_id, round(list_dot_product(dd.v, dq.v), 9) AS score FROM dq, dd), dr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ds)"""


@query(SPARSE_SQL + ", " + DENSE_SQL + """, f AS (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS left_rank, b.rank AS right_rank, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score
FROM (SELECT * FROM r WHERE rank <= 50) a FULL JOIN (SELECT * FROM dr WHERE rank <= 50) b ON a.item_id = b.item_id AND a.doc_id = b.doc_id),
t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM f) SELECT item_id, doc_id, coalesce(left_rank, 0) AS left_rank, coalesce(right_rank, 0) AS right_rank, round(score, 9) AS score, rank FROM t WHERE rank <= 10""")
def rrf_hybrid(table):
    """Hashed sparse and dense rankings of all documents for each benchmark item, fused by reciprocal rank."""
    dense = relational.top_k(rules.dense_scores(table("benchmark"), "item_id", table("documents"), "doc_id"), ["item_id"], [F.desc("score"), F.asc("doc_id")], 50)
    both = relational.fused(_sparse_ranks(table, 50).select("item_id", "doc_id", "rank"), dense.select("item_id", "doc_id", "rank"), ["item_id"], "doc_id")
    best = relational.top_k(both, ["item_id"], [F.desc(F.round("score", 12)), F.asc("doc_id")], 10)
    return best.withColumn("score", F.round("score", 9)).na.fill(0, ["left_rank", "right_rank"])


@query("""WITH s AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def dense_topk(table):
    """The ten nearest rows of each query row, one in fifty, among all rows."""
    return nearest.top_products(table("embeddings").select("vec_id", "embedding"), "vec_id % 50 = 0", 10)


@query("SELECT d.source, count(*) AS pairs, count(DISTINCT b.item_id) AS items FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY d.source")
def gold_containment(table):
    pairs = relational.containing(table("documents"), "doc_id", table("benchmark"), "item_id")
    return pairs.join(table("documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("item_id").alias("items"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS votes, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c)
SELECT user_id, event_type AS winner, n AS winner_votes, CAST(votes AS BIGINT) AS votes, round(n / votes, 6) AS share, n >= votes // 2 + 1 AS passed FROM t WHERE r = 1""")
def self_consistency_vote(table):
    found = relational.majority(table("events").select("user_id", "event_type"), ["user_id"], "event_type")
    return found.withColumn("share", F.round("share", 6))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_claim(table):
    return relational.latest(table("events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


SPANS_SQL = f"SELECT doc_id, seq, line, (doc_id * 7 + seq) % 40 AS a, (doc_id * 7 + seq) % 40 + 5 + seq % 60 AS b FROM ({LINES_SQL}) WHERE trim(line) <> ''"


@query(f"""WITH s AS ({SPANS_SQL}), g AS (SELECT doc_id, seq, a <= b AND b <= length(line) AND a < b AS ex, b <= length(line) AND substr(line, a + 1, b - a) = CASE WHEN seq % 11 = 3 THEN upper(substr(line, a + 1, b - a)) ELSE substr(line, a + 1, b - a) END AS ve, length(line) % 7 > 0 AS en, length(line) % 5 > 0 AS sc FROM s)
SELECT doc_id, count(*) AS claims, count(*) FILTER (NOT (ex AND ve)) AS rejected, count(*) FILTER (ex AND ve AND NOT (en AND sc)) AS flagged, count(*) FILTER (ex AND ve AND en AND sc) AS verified,
string_agg(DISTINCT CASE WHEN NOT ex THEN 'span_existence' WHEN NOT ve THEN 'verbatim_match' WHEN NOT en THEN 'entailment' WHEN NOT sc THEN 'self_consistency' END, ',' ORDER BY CASE WHEN NOT ex THEN 'span_existence' WHEN NOT ve THEN 'verbatim_match' WHEN NOT en THEN 'entailment' WHEN NOT sc THEN 'self_consistency' END) AS first_failures FROM g GROUP BY doc_id""")
def gate_status(table):
    """Four gates over spans made up from each element, and the status that follows from them."""
    claims = rules.made_up_spans(table("documents"))
    gated = claims.withColumns(rules.gates())
    status = rules.status_of(*(F.col(g) for g in rules.GATES))
    failure = F.coalesce(*(F.when(~F.col(g), g) for g in rules.GATES))
    counts = [F.count_if(status == s).alias(s) for s in ("rejected", "flagged", "verified")]
    return gated.groupBy("doc_id").agg(F.count(F.lit(1)).alias("claims"), *counts, F.array_join(F.array_sort(F.collect_set(failure)), ",").alias("first_failures")).withColumn("first_failures", F.nullif("first_failures", F.lit("")))


@query("""WITH s AS (SELECT source, count(DISTINCT lang) AS reached, count(*) AS docs, count(*) FILTER (n_chars > 1500) AS long FROM documents GROUP BY source), e AS (SELECT count(DISTINCT lang) AS expected FROM documents)
SELECT source, round(reached / expected, 6) AS ratio, round(long / docs, 6) AS recall, CASE WHEN reached / expected < 0.5 THEN 'insufficient_coverage' WHEN long > 0.6 * docs THEN 'evidence_found' ELSE 'no_evidence_in_searched_corpus' END AS state, NOT long > 0.6 * docs AND reached / expected >= 0.9 AND long / docs >= 0.4 AS defensible FROM s, e""")
def completeness(table):
    """Sources against the languages expected of them: coverage ratio, downgrade below one half, defensible zeros."""
    docs = table("documents")
    found = docs.groupBy("source").agg(F.countDistinct("lang").alias("reached"), F.count(F.lit(1)).alias("docs"), F.count_if(F.col("n_chars") > 1500).alias("long"))
    found = found.crossJoin(docs.agg(F.countDistinct("lang").alias("expected")))
    ratio, recall = F.col("reached") / F.col("expected"), F.col("long") / F.col("docs")
    state = rules.with_completeness(rules.coverage_state(F.col("long") > 0.6 * F.col("docs"), recall), ratio)
    return found.select("source", F.round(ratio, 6).alias("ratio"), F.round(recall, 6).alias("recall"), state.alias("state"), rules.defensible_zero(state, recall, ratio, 0.4, 0.9).alias("defensible"))


@query("""WITH i AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + (value * 600)::BIGINT AS e FROM events WHERE value IS NOT NULL), o AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i WHERE e > s),
k AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS g FROM o) SELECT user_id, min(s) AS start, max(e) AS "end", count(*) AS parts FROM k GROUP BY user_id, g""")
def interval_merge(table):
    begin = F.unix_timestamp(F.col("ts").cast("timestamp"))
    spans = table("events").where("value is not null").select("user_id", begin.alias("start"), (begin + F.round(F.col("value") * 600).cast("long")).alias("end"))
    return relational.merged_intervals(spans, ["user_id"], "start", "end")


AUTHORITY = [(1, "^(A|B)", "tier_1_statute"), (2, "IN", "tier_2_regulation"), (3, "A$", "tier_3_guideline")]


@query(f"""WITH o(ord, pattern, tier) AS (VALUES {', '.join(f"({o}, '{p}', '{t}')" for o, p, t in AUTHORITY)}), n AS (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT s_suppkey, n_name, arg_min(tier, ord) AS tier FROM n JOIN o ON regexp_matches(n_name, pattern) GROUP BY ALL)
SELECT n.s_suppkey, coalesce(m.tier, 'tier_4_informal') AS tier, CASE coalesce(m.tier, '') WHEN 'tier_1_statute' THEN 4 WHEN 'tier_2_regulation' THEN 3 WHEN 'tier_3_guideline' THEN 2 ELSE 1 END AS rank FROM n LEFT JOIN m USING (s_suppkey)""")
def authority_override(table):
    """The first override whose pattern matches a supplier's nation, else the declared tier."""
    rows = table("supplier").join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    tier = rules.first_match(F.col("n_name"), [(p, t) for _, p, t in AUTHORITY], "tier_4_informal")
    return rows.select("s_suppkey", tier.alias("tier"), rules.authority_rank(tier).alias("rank"))


@query("""WITH c AS (SELECT conv_id, turn, length(text) AS n, CASE WHEN role = 'system' THEN 'no_evidence' WHEN length(text) < 100 THEN 'insufficient' WHEN length(text) % 3 = 0 THEN 'flagged' WHEN length(text) % 3 = 1 THEN 'rejected' ELSE 'verified' END AS state FROM conversations)
SELECT conv_id, turn, state, row_number() OVER (ORDER BY CASE state WHEN 'no_evidence' THEN 0 WHEN 'insufficient' THEN 1 WHEN 'flagged' THEN 2 WHEN 'rejected' THEN 3 ELSE 5 END, conv_id, turn, n) AS position FROM c QUALIFY position <= 50""")
def review_queue(table):
    """The first fifty entries of the queue: coverage gaps, then flagged, rejected and other claims."""
    n = F.length("text")
    state = F.when(F.col("role") == "system", "no_evidence").when(n < 100, "insufficient").when(n % 3 == 0, "flagged").when(n % 3 == 1, "rejected").otherwise("verified")
    rows = table("conversations").select("conv_id", "turn", n.alias("n"), state.alias("state"))
    first = rows.orderBy(rules.queue_rank(F.col("state")), "conv_id", "turn", "n").limit(50)
    order = Window.orderBy(rules.queue_rank(F.col("state")), "conv_id", "turn", "n")
    return first.select("conv_id", "turn", "state", F.row_number().over(order).alias("position"))


@query("""WITH s AS (SELECT doc_id, len(list_intersect(w, ['the', 'of', 'and'])) AS z, len(list_intersect(w, ['the', 'is', 'was'])) AS h, len(list_intersect(w, ['that', 'shall', 'a'])) AS o, len(list_filter(['tion', 'ing'], lambda k: contains(lower(text), k))) AS pos, len(list_filter(['except', 'unless'], lambda k: contains(lower(text), k))) AS neg FROM (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)),
b AS (SELECT doc_id, z + 0.25 * pos AS s0, h + 0.25 * pos + 0.25 * neg AS s5, o + 0.25 * pos - 0.5 * neg AS s1 FROM s)
SELECT doc_id, s0::DOUBLE AS s0, s5::DOUBLE AS s5, s1::DOUBLE AS s1, CASE WHEN greatest(s0, s5, s1) <= 0 THEN '0.5' WHEN greatest(s0, s5, s1) - list_sort([s0, s5, s1])[2] < 0.5 THEN '0.5' WHEN s0 = greatest(s0, s5, s1) THEN '0' WHEN s5 = greatest(s0, s5, s1) THEN '0.5' ELSE '1' END AS band FROM b""")
def layer2_bands(table):
    """Recommended score bands from overlap with the bands' criteria, keywords and cues."""
    criteria = {"0": ["the", "of", "and"], "0.5": ["the", "is", "was"], "1": ["that", "shall", "a"]}
    scores = rules.band_scores(F.col("text"), criteria, ["tion", "ing"], ["except", "unless"])
    rows = table("documents").select("doc_id", *(s.alias(n) for s, n in zip(scores, ("s0", "s5", "s1"), strict=True)))
    return rows.withColumn("band", rules.band_pick(F.col("s0"), F.col("s5"), F.col("s1")))


@query("""SELECT doc_id, CASE WHEN regexp_matches(i, '^(P\\d+-I\\d+|\\d+\\.\\d+)$') THEN 'P' || regexp_extract(i, '(\\d+)', 1)::INT || '-I' || regexp_extract(i, '\\d+[^0-9]+(\\d+)$', 1)::INT END AS display, replace(lower(trim(source)), 'ß', 'ss') AS source_key FROM (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN doc_id || '.0' || (doc_id % 7) WHEN 1 THEN 'P' || doc_id || '-I' || (doc_id % 3) WHEN 2 THEN doc_id || '.1.2' ELSE doc_id || '.' || (doc_id % 9) END AS i FROM documents)""")
def indicator_alias(table):
    d = F.col("doc_id")
    ident = F.when(d % 4 == 0, F.concat(d, F.lit(".0"), d % 7)).when(d % 4 == 1, F.concat(F.lit("P"), d, F.lit("-I"), d % 3)).when(d % 4 == 2, F.concat(d, F.lit(".1.2"))).otherwise(F.concat(d, F.lit("."), d % 9))
    return table("documents").select("doc_id", T.display_indicator(ident).alias("display"), T.folded(F.col("source")).alias("source_key"))
