"""Queries over claims: classification, grounding, panels, reviews, citations, run summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evigrain.functions import text as T
from evigrain.operators import elements, relational
from evigrain.plans.corpus import ANCHORS_SQL, LINES_SQL
from evigrain.plans.evidence import INDICATOR_SQL, SCORE_SQL, _indicators
from evigrain.plans.registry import query


@query(f"""WITH s AS (SELECT doc_id, indicator_id, {SCORE_SQL.format('lower(text)')} AS score FROM documents, {INDICATOR_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, indicator_id) AS r FROM s)
SELECT doc_id, indicator_id, CAST(score AS BIGINT) AS score, md5(concat_ws('|', 'x', doc_id, indicator_id)) AS claim_id FROM r WHERE r = 1""")
def keyword_classifier(table):
    """The indicator with most keyword occurrences, the first among equals, and the claim's id."""
    scored = table("documents").crossJoin(F.broadcast(_indicators(table))).select("doc_id", "indicator_id", T.keyword_score(F.lower("text"), F.col("keywords")).alias("score"))
    best = relational.latest(scored, ["doc_id"], [F.desc("score"), F.asc("indicator_id")])
    return best.select("doc_id", "indicator_id", "score", F.md5(F.concat_ws("|", F.lit("x"), "doc_id", "indicator_id").cast("binary")).alias("claim_id"))


@query(r"""WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) AS latin, length(regexp_replace(text, '[^\p{Cyrillic}]', '', 'g')) AS cyrillic, length(regexp_replace(text, '[^\p{Han}\p{Hiragana}\p{Katakana}]', '', 'g')) AS cjk, length(regexp_replace(text, '[^\p{Arabic}]', '', 'g')) AS arabic FROM documents)
SELECT doc_id, latin, CASE WHEN latin + cyrillic + cjk + arabic = 0 THEN 'unknown' WHEN latin >= greatest(cyrillic, cjk, arabic) THEN 'latin' WHEN cjk >= greatest(cyrillic, arabic) THEN 'cjk' WHEN cyrillic >= arabic THEN 'cyrillic' ELSE 'arabic' END AS script FROM c""")
def script_detect(table):
    kept = lambda classes: F.length(F.regexp_replace("text", f"[^{classes}]", ""))
    rows = table("documents").select("doc_id", kept(r"\p{IsLatin}").alias("latin"), kept(r"\p{IsCyrillic}").alias("cyrillic"), kept(r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}").alias("cjk"), kept(r"\p{IsArabic}").alias("arabic"))
    script = F.when(F.col("latin") + F.col("cyrillic") + F.col("cjk") + F.col("arabic") == 0, "unknown").when(F.col("latin") >= F.greatest("cyrillic", "cjk", "arabic"), "latin").when(F.col("cjk") >= F.greatest("cyrillic", "arabic"), "cjk").when(F.col("cyrillic") >= F.col("arabic"), "cyrillic").otherwise("arabic")
    return rows.select("doc_id", "latin", script.alias("script"))


@query("""WITH v AS (SELECT user_id, event_type AS lens, avg(value) > 40 AS refutes FROM events GROUP BY ALL)
SELECT user_id, count(*) AS lenses, count(*) FILTER (refutes) AS refuted, coalesce(string_agg(lens, ',' ORDER BY lens) FILTER (refutes), '') AS refuted_by, count(*) FILTER (refutes) < count(*) // 2 + 1 AS survives, round((count(*) - count(*) FILTER (refutes)) / count(*), 6) AS score FROM v GROUP BY user_id""")
def adversarial_panel(table):
    """Every user's kinds of events as a panel of lenses; one refutes where its mean value is over 40."""
    votes = table("events").groupBy("user_id", F.col("event_type").alias("lens")).agg((F.avg("value") > 40).alias("refutes"))
    return relational.panel_verdicts(votes, "user_id", "lens", "refutes").withColumn("score", F.round("score", 6))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS made FROM events GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS votes, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, made) AS r FROM c)
SELECT r.user_id, r.event_type AS indicator, e.event_id, e.value, md5(concat_ws('|', 'x', r.user_id, r.event_type)) AS claim_id, n AS winner_votes, CAST(votes AS BIGINT) AS votes FROM r JOIN events e ON e.event_id = made WHERE r.r = 1""")
def claim_construction(table):
    """A claim of each user's samples: the first sample of the choice with most votes, with its own columns."""
    found = relational.modal_samples(table("events").select("user_id", "event_type", "event_id", "value"), ["user_id"], "event_type", "event_id")
    claim = F.md5(F.concat_ws("|", F.lit("x"), "user_id", "event_type").cast("binary"))
    return found.select("user_id", F.col("event_type").alias("indicator"), "event_id", "value", claim.alias("claim_id"), "winner_votes", "votes")


GROUND_SQL = f"""WITH l AS ({LINES_SQL}), s AS (SELECT doc_id, max(seq) AS last FROM l GROUP BY doc_id), e AS (SELECT DISTINCT l.doc_id, lower(unnest(regexp_extract_all(line, '[A-Z][a-z]+'))) AS entity FROM l JOIN s ON l.doc_id = s.doc_id AND l.seq = s.last),
k AS (SELECT DISTINCT l.doc_id, unnest(regexp_extract_all(lower(line), '[a-z]+')) AS entity FROM l JOIN s ON l.doc_id = s.doc_id AND l.seq < s.last)"""


@query(GROUND_SQL + """ SELECT e.doc_id, count(*) AS entities, count(k.entity) AS grounded, round(count(k.entity) / count(*), 6) AS score, count(k.entity) >= 0.5 * count(*) AS passed, coalesce(string_agg(e.entity, ',' ORDER BY e.entity) FILTER (k.entity IS NULL), '') AS unresolved FROM e LEFT JOIN k ON e.doc_id = k.doc_id AND e.entity = k.entity GROUP BY e.doc_id""")
def entity_grounding(table):
    """Entities of the last element that the elements before it know."""
    lines = table("documents").select("doc_id", F.split("text", "\n", -1).alias("l"))
    claimed = F.array_distinct(F.transform(F.regexp_extract_all(F.element_at("l", -1), F.lit("[A-Z][a-z]+"), F.lit(0)), F.lower))
    known = F.array_distinct(F.flatten(F.transform(F.slice("l", F.lit(1), F.size("l") - 1), lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0)))))
    rows = lines.select("doc_id", claimed.alias("c"), known.alias("k")).where("size(c) > 0")
    grounded, entities = F.size(F.array_intersect("c", "k")), F.size("c")
    return rows.select("doc_id", entities.cast("long").alias("entities"), grounded.cast("long").alias("grounded"), F.round(grounded / entities, 6).alias("score"), (grounded >= 0.5 * entities).alias("passed"), F.array_join(F.array_sort(F.array_except("c", "k")), ",").alias("unresolved"))


@query("""WITH g AS (SELECT item_id, max(CASE WHEN contains(d.text, b.text) THEN 1 ELSE 0 END) = 1 AS inside FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id), o AS (SELECT item_id, inside, CASE WHEN item_id % 7 = 3 THEN true END AS override FROM g)
SELECT count(*) AS gold, count(*) FILTER (coalesce(override, NOT inside)) AS outside, round(avg(CASE WHEN coalesce(override, NOT inside) THEN 1.0 ELSE 0.0 END), 6) AS out_of_corpus_fraction FROM o""")
def out_of_corpus(table):
    """Gold items that no document holds; some are declared to be outside."""
    items = table("benchmark").select("item_id", "text")
    inside = relational.containing(table("documents"), "doc_id", items, "item_id").select("item_id").distinct().withColumn("inside", F.lit(True))
    outside = F.coalesce(F.when(F.col("item_id") % 7 == 3, True), F.col("inside").isNull())
    found = items.join(inside, "item_id", "left").withColumn("outside", outside)
    return found.agg(F.count(F.lit(1)).alias("gold"), F.count_if("outside").alias("outside"), F.round(F.avg(F.col("outside").cast("double")), 6).alias("out_of_corpus_fraction"))


@query("""WITH r AS (SELECT conv_id, turn, CASE length(text) % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'correct' ELSE 'reject' END AS decision FROM conversations), l AS (SELECT conv_id, arg_max(decision, turn) AS latest, bool_or(decision <> 'accept') AS overridden FROM r GROUP BY conv_id)
SELECT count(*) AS reviewed, round(avg(CASE WHEN latest = 'accept' THEN 1.0 ELSE 0.0 END), 6) AS citation_support, round(avg(CASE WHEN overridden THEN 1.0 ELSE 0.0 END), 6) AS override_rate FROM l""")
def review_rates(table):
    """Latest decisions that accept, and claims that a reviewer ever overrode."""
    n = F.length("text") % 3
    decision = F.when(n == 0, "accept").when(n == 1, "correct").otherwise("reject")
    latest = table("conversations").withColumn("decision", decision).groupBy("conv_id").agg(F.max_by("decision", "turn").alias("latest"), F.bool_or(F.col("decision") != "accept").alias("overridden"))
    return latest.agg(F.count(F.lit(1)).alias("reviewed"), F.round(F.coalesce(F.avg((F.col("latest") == "accept").cast("double")), F.lit(1.0)), 6).alias("citation_support"), F.round(F.avg(F.col("overridden").cast("double")), 6).alias("override_rate"))


@query("""WITH s AS (SELECT event_id, value / 10 AS a, (event_id % 7) / 2 AS b, 1.0::DOUBLE AS c FROM events), m AS (SELECT *, greatest(a, b, c) AS top FROM s), e AS (SELECT *, exp(a - top) AS x, exp(b - top) AS y, exp(c - top) AS z FROM m)
SELECT event_id, round(x / (x + y + z), 6) AS entails, round(y / (x + y + z), 6) AS neutral, x / (x + y + z) > 0.6 AS passed FROM e WHERE a IS NOT NULL""")
def entailment_softmax(table):
    """Probabilities of three logits and the entailment gate's verdict."""
    logits = [F.col("value") / 10, (F.col("event_id") % 7) / 2, F.lit(1.0)]
    rows = table("events").where("value is not null").withColumn("top", F.greatest(*logits))
    parts = [F.exp(v - F.col("top")) for v in logits]
    whole = parts[0] + parts[1] + parts[2]
    return rows.select("event_id", F.round(parts[0] / whole, 6).alias("entails"), F.round(parts[1] / whole, 6).alias("neutral"), (parts[0] / whole > 0.6).alias("passed"))


@query(f"""WITH s AS (SELECT indicator_id, doc_id, {SCORE_SQL.format('lower(text)')} AS score FROM documents, {INDICATOR_SQL}), h AS (SELECT *, row_number() OVER (PARTITION BY indicator_id ORDER BY score DESC, doc_id) AS hit FROM s WHERE score > 0), t AS (SELECT * FROM h WHERE hit <= 40)
SELECT doc_id, arg_min(indicator_id, (indicator_id, hit)) AS indicator_id, count(*) AS hits FROM t GROUP BY doc_id""")
def first_seen_clauses(table):
    """Each document under the first indicator that hits it."""
    docs = table("documents").crossJoin(F.broadcast(_indicators(table)))
    scored = docs.select("indicator_id", "doc_id", T.keyword_score(F.lower("text"), F.col("keywords")).alias("score")).where("score > 0")
    best = relational.top_k(scored, ["indicator_id"], [F.desc("score"), F.asc("doc_id")], 40)
    return best.groupBy("doc_id").agg(F.min_by("indicator_id", F.struct("indicator_id", "rank")).alias("indicator_id"), F.count(F.lit(1)).alias("hits"))


@query(f"""WITH a AS ({ANCHORS_SQL}), h AS (SELECT page_id, seq, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)) || regexp_replace(href, '/+$', '') AS target FROM a WHERE href LIKE '/%')
SELECT target, min(page_id) AS page_id, count(*) AS links, regexp_matches(lower(target), '\\.(pdf|docx?|xlsx?)$') AS terminal FROM h GROUP BY target""")
def link_targets(table):
    """Absolute targets of root-relative links, each once, with the first page that has it."""
    links = elements.anchors(table("pages")).where(F.col("href").startswith("/"))
    target = F.concat(F.lower(F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]+)", 1)), F.regexp_replace("href", "/+$", ""))
    return links.groupBy(target.alias("target")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("links")).withColumn("terminal", F.lower("target").rlike(r"\.(pdf|docx?|xlsx?)$"))


@query(f"""WITH l AS ({LINES_SQL}), c AS (SELECT doc_id, lang, source, seq, trim(substr(line, 1, 60)) AS snippet, row_number() OVER (PARTITION BY source ORDER BY doc_id, seq) AS ord FROM l WHERE trim(line) <> '')
SELECT source, count(*) AS citations, string_agg(snippet, ' / ' ORDER BY ord) AS text FROM c WHERE ord <= 3 GROUP BY source""")
def grouped_citations(table):
    """The first three citations of each source, in order."""
    rows = elements.paragraphs(table("documents")).join(table("documents").select("doc_id", "source"), "doc_id")
    first = relational.top_k(rows.select("source", "doc_id", "seq", F.trim(F.substring("text", 1, 60)).alias("snippet")), ["source"], [F.asc("doc_id"), F.asc("seq")], 3)
    parts = F.array_sort(F.collect_list(F.struct("rank", "snippet")))
    return first.groupBy("source").agg(F.count(F.lit(1)).alias("citations"), F.array_join(F.transform(parts, lambda x: x["snippet"]), " / ").alias("text"))


@query("""WITH d AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY lang ORDER BY source = 'src3' DESC, doc_id) AS r FROM documents WHERE n_chars > 1000) SELECT n_nationkey, doc_id, source = 'src3' AS preferred FROM nation LEFT JOIN d ON r = 1 AND lang = CASE n_regionkey WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' WHEN 3 THEN 'es' END WHERE doc_id IS NOT NULL""")
def best_match(table):
    """A claim for each gold row: of the same language, of the preferred source if there is one, the first in order."""
    lang = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), F.col("n_regionkey") + 1)
    gold = table("nation").where("n_regionkey < 4").select("n_nationkey", lang.alias("lang"))
    preferred = (F.col("source") == "src3").alias("preferred")
    claims = table("documents").where("n_chars > 1000").select("lang", "doc_id", preferred)
    return gold.join(relational.latest(claims, ["lang"], [F.desc("preferred"), F.asc("doc_id")]), "lang").select("n_nationkey", "doc_id", "preferred")


@query("""SELECT user_id, count(*) AS steps, count(*) FILTER (event_type = 'error') AS errors, CASE WHEN count(*) FILTER (event_type = 'error') = count(*) THEN 'failed' WHEN count(*) FILTER (event_type = 'error') > 0.25 * count(*) THEN 'degraded' ELSE 'completed' END AS status, arg_max(event_type, (ts, event_id)) AS last_step FROM events GROUP BY user_id""")
def run_status(table):
    errors, steps = F.count_if(F.col("event_type") == "error"), F.count(F.lit(1))
    status = F.when(errors == steps, "failed").when(errors > 0.25 * steps, "degraded").otherwise("completed")
    return table("events").groupBy("user_id").agg(steps.alias("steps"), errors.alias("errors"), status.alias("status"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_step"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS seq, l_quantity FROM lineitem) SELECT a.l_orderkey, a.l_linenumber, coalesce(b.l_linenumber, a.l_linenumber) AS parent, coalesce(c.l_linenumber, -1) AS neighbour FROM e a LEFT JOIN e b ON a.l_orderkey = b.l_orderkey AND b.seq = 1 AND a.seq > 1 LEFT JOIN e c ON a.l_orderkey = c.l_orderkey AND c.seq = a.seq - 1""")
def parent_map(table):
    """Each element's parent, itself if it has none, and the sibling before it."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    first = F.first("l_linenumber").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return table("lineitem").select("l_orderkey", "l_linenumber", first.alias("parent"), F.coalesce(F.lag("l_linenumber").over(order), F.lit(-1)).alias("neighbour"))
