"""Queries over submissions and the second layer: provision rows, their violations and package, recommended bands, recall of passages, costs under two price tables, the coverage grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain.functions import text as T
from evigrain.operators import costs, elements, review, rules, scoring, submission
from evigrain.plans.corpus import LINES_SQL
from evigrain.plans.registry import query

FIRST_SENTENCE = "instr(line, '.')"
PROVISIONS_SQL = f"""WITH l AS (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY seq) - length(line) - 1 AS BIGINT) AS begin FROM ({LINES_SQL})),
e AS (SELECT *, CASE WHEN {FIRST_SENTENCE} = 0 THEN line WHEN seq % 2 = 0 THEN substr(line, 1, {FIRST_SENTENCE}) WHEN begin < begin + {FIRST_SENTENCE} AND begin + {FIRST_SENTENCE} <= length(line) THEN substr(line, begin + 1, {FIRST_SENTENCE}) ELSE substr(line, 1, {FIRST_SENTENCE}) END AS cut FROM l WHERE trim(line) <> ''),
p AS (SELECT e.doc_id || '_p' || seq AS claim_id, e.doc_id, lang AS economy, CASE WHEN lang = 'en' THEN source || ' ' || e.doc_id WHEN quality IS NOT NULL THEN 'Law ' || e.doc_id ELSE e.doc_id::VARCHAR END AS law_name, CASE WHEN quality IS NULL THEN '' WHEN toxic = 1 THEN 'Law ' || e.doc_id ELSE 'No. ' || e.doc_id END AS law_number_ref, '' AS last_amended,
CASE WHEN regexp_matches(source, '^src[0-9]+$') THEN 'P6-I' || substr(source, 4)::INT ELSE replace(source, 'src', '6.') END AS indicator_id, CASE WHEN regexp_matches(line, '^[A-Z][a-z]+ ') THEN 's. ' || seq || '(1)' ELSE 'para p' || seq END AS article, CASE WHEN quality = 1 THEN 'KNOWN' ELSE 'NEW' END AS discovery_tag, CASE WHEN seq > 0 THEN 'page ' || seq ELSE '' END AS location_reference,
regexp_replace(cut, '^\\s+|\\s+$', '', 'g') AS verbatim_snippet, substr(lang || ': ' || line, 1, 300) AS mapping_rationale, CASE WHEN quality IS NULL THEN '' ELSE 'https://law.example.org/' || e.doc_id END AS source_url, CASE WHEN seq = 0 THEN '' ELSE printf('%.2f', least(1.0::DOUBLE, length(line) / 300)) END AS confidence,
'layer1_status=' || CASE WHEN quality IS NULL THEN 'pending_verification' WHEN toxic = 1 THEN 'flagged' ELSE 'verified' END AS notes FROM e LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 1)"""


def _provisions(table):
    """A claim for each line of a document, with its first sentence as evidence; every other line's offsets are those of the document. Labels are the sources, the reports and what is known."""
    docs, labels = table("documents"), table("labels")
    lines = elements.paragraphs(docs).join(docs.select("doc_id", "lang", "source"), "doc_id")
    base, end = F.when(F.col("seq") % 2 == 1, F.col("char_start")).otherwise(0), F.instr("text", ".")
    span = F.when(end > 0, F.array(F.struct("doc_id", base.alias("char_start"), (base + end).alias("char_end")))).otherwise(F.array(F.struct("doc_id", F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"))))
    claims = lines.select(
        F.col("element_id").alias("claim_id"), F.col("lang").alias("jurisdiction"), F.replace("source", F.lit("src"), F.lit("6.")).alias("indicator_id"), F.col("element_id").alias("clause_id"), span.alias("spans"), F.col("lang").alias("subject"), F.col("text").alias("constraint"),
        F.when(F.col("seq") > 0, F.least(F.lit(1.0), F.length("text") / 300)).alias("model_confidence"),
    )
    numbering = F.when(F.col("text").rlike("^[A-Z][a-z]+ "), F.concat(F.lit("s. "), "seq", F.lit("(1)")))
    parts = elements.paragraphs(docs).select("element_id", "text", "char_start", numbering.alias("numbering"), F.col("seq").alias("page"))
    laws = docs.select("doc_id", F.when(F.col("lang") == "en", F.concat_ws(" ", "source", "doc_id")).alias("title"), F.lit(None).cast("string").alias("source_url"))
    number = F.when(F.col("toxic") == 1, "").otherwise(F.concat(F.lit("No. "), "doc_id"))
    sources = labels.select(F.col("doc_id").alias("source_id"), F.concat(F.lit("Law "), "doc_id").alias("title"), number.alias("law_number_ref"), F.lit(None).cast("string").alias("last_amended"), F.concat(F.lit("https://law.example.org/"), "doc_id").alias("source_url"))
    marked = lines.select("doc_id", F.col("element_id").alias("claim_id")).join(labels, "doc_id")
    status = review.layer1_status(F.col("quality") == 1, F.col("toxic") == 1)
    reports = marked.select("claim_id", F.when(status == "pending_verification", "verified").otherwise(status).alias("status"))
    tags = marked.select("claim_id", F.when(F.col("quality") == 1, "KNOWN").otherwise("NEW").alias("discovery_tag"))
    return submission.provision_records(claims, parts, laws, sources, reports, tags)


@query(PROVISIONS_SQL + f" SELECT claim_id, {', '.join(rules.PROVISION_COLUMNS)} FROM p")
def provision_records(table):
    """The 13 columns for each line of a document that isn't labelled bad."""
    return _provisions(table)


@query(PROVISIONS_SQL + """, v AS (SELECT claim_id, unnest(list_filter([CASE WHEN trim(law_name) = '' THEN 'missing law_name' END, CASE WHEN trim(law_number_ref) = '' THEN 'missing law_number_ref' END, CASE WHEN trim(indicator_id) = '' THEN 'missing indicator_id' END, CASE WHEN trim(article) = '' THEN 'missing article' END, CASE WHEN trim(verbatim_snippet) = '' THEN 'missing verbatim_snippet' END,
CASE WHEN trim(source_url) = '' THEN 'missing source_url' END, CASE WHEN article <> '' AND NOT regexp_matches(article, '\\(') THEN 'article lacks paragraph' END, CASE WHEN NOT regexp_matches(indicator_id, '^P[0-9]+-I[0-9]+$') THEN 'bad indicator_id' END], lambda x: x IS NOT NULL)) AS violation FROM p)
SELECT claim_id, violation FROM v""")
def provision_violations(table):
    """Conformance rules that the provision rows of the documents break."""
    return rules.violations(_provisions(table).withColumnRenamed("claim_id", "doc_id")).withColumnRenamed("doc_id", "claim_id")


@query(PROVISIONS_SQL + """ SELECT 'all' AS economy, '6-7' AS pillars, 'run' AS generated_at, count(*) AS provisions, count(*) FILTER (discovery_tag = 'NEW') AS new, count(*) FILTER (discovery_tag = 'KNOWN') AS known,
(SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)) AS cost FROM p""")
def evidence_package(table):
    """The head of the package of all provisions, with the number of events of each kind as its costs."""
    paid = table("events").groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    head = submission.package_head(_provisions(table), paid, "all", ["6", "7"], "run", "none")
    cost = F.array_join(F.transform(F.map_entries("cost"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("long"))), ",")
    return head.select("economy", F.array_join("pillar_ids", "-").alias("pillars"), "generated_at", "counts.provisions", "counts.new", "counts.known", cost.alias("cost"))


WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
SHARED = "len(list_intersect(w, coalesce(" + WORDS.format("{}") + ", []))) * 1.0::DOUBLE"
MET = "len(list_filter({}, lambda k: contains(low, k)))"
RECOMMENDED_SQL = rf"""WITH b AS (SELECT 'src' || (item_id % 20) AS indicator_id, CASE (item_id // 20) % 3 WHEN 0 THEN '0' WHEN 1 THEN '0.5' ELSE '1' END AS band, min(item_id) AS ord, arg_min(text, item_id) AS rubric FROM benchmark GROUP BY ALL),
i AS (SELECT indicator_id, arg_min(rubric, ord) AS first, max(rubric) FILTER (band = '0') AS r0, max(rubric) FILTER (band = '0.5') AS r5, max(rubric) FILTER (band = '1') AS r1 FROM b GROUP BY 1),
k AS (SELECT *, regexp_extract_all(lower(first), '[a-z0-9]+')[1:2] AS pos, regexp_extract_all(lower(first), '[a-z0-9]+')[3:4] AS neg, CASE WHEN contains(first, 'that') THEN 'conditional_regime' WHEN contains(first, 'ing') THEN 'prohibition' END AS expected FROM i),
c AS (SELECT d.doc_id AS claim_id, lang AS jurisdiction, source AS indicator_id, text, n_chars, lower(text) AS low, {WORDS.format('text')} AS w, CASE WHEN quality = 0 THEN 'rejected' WHEN toxic = 1 THEN 'flagged' ELSE 'verified' END AS status, CASE WHEN contains(lower(text), ' with ') THEN 'conditional_regime' ELSE 'prohibition' END AS pattern,
len(string_split(text, chr(10))) AS m, len(string_split(lower(text), ' not ')) - 1 AS x, len(string_split(lower(text), ' is ')) - 1 AS f FROM documents d JOIN labels USING (doc_id)),
v AS (SELECT jurisdiction, indicator_id, CASE WHEN count(*) FILTER (status = 'verified' AND n_chars >= 1500) > 0 THEN 'evidence_found' WHEN count(*) >= 2 THEN 'no_evidence_in_searched_corpus' ELSE 'insufficient_coverage' END AS state FROM c GROUP BY ALL),
s AS (SELECT c.*, k.* EXCLUDE (indicator_id), state, {SHARED.format('r0')} + 0.25 * {MET.format('pos')} AS s0, {SHARED.format('r5')} + 0.25 * {MET.format('pos')} + 0.25 * {MET.format('neg')} + CASE WHEN pattern = expected THEN 0.5 ELSE 0 END + CASE WHEN pattern = 'conditional_regime' THEN 0.75 ELSE 0 END AS s5,
{SHARED.format('r1')} + 0.25 * {MET.format('pos')} - 0.5 * {MET.format('neg')} - CASE WHEN pattern = 'conditional_regime' THEN 0.25 ELSE 0 END AS s1 FROM c JOIN k USING (indicator_id) JOIN v USING (jurisdiction, indicator_id) WHERE status = 'verified'),
z AS (SELECT claim_id, b.band, ord, len(list_intersect(s.w, {WORDS.format('b.rubric')})) / len(list_distinct(s.w || {WORDS.format('b.rubric')})) AS o FROM s JOIN b USING (indicator_id) WHERE len(s.w) > 0),
y AS (SELECT claim_id, CASE WHEN max(o) >= 0.15 THEN arg_max(band, (o, -ord)) END AS shot FROM z WHERE o > 0 GROUP BY 1),
p AS (SELECT s.*, CASE WHEN state <> 'evidence_found' OR n_chars < 1500 THEN NULL WHEN shot IS NOT NULL THEN shot WHEN greatest(s0, s5, s1) <= 0 OR greatest(s0, s5, s1) - list_sort([s0, s5, s1])[2] < 0.5 THEN '0.5' WHEN s0 = greatest(s0, s5, s1) THEN '0' WHEN s5 = greatest(s0, s5, s1) THEN '0.5' ELSE '1' END AS band FROM s LEFT JOIN y USING (claim_id))
SELECT claim_id, coalesce(band, 'null') AS band, CASE WHEN state <> 'evidence_found' THEN 'No verified evidence band recommended — coverage is ' || state || '.' WHEN n_chars < 1500 THEN '{scoring.NOT_COUNTED}'
ELSE 'Structure = ' || indicator_id || ' (' || pattern || '); recommended band ' || band || '. ' || coalesce('Rubric: ' || CASE band WHEN '0' THEN r0 WHEN '0.5' THEN r5 ELSE r1 END || ' ', '') || 'Regime assembly: ' || m || ' member(s), ' || x || ' exception(s), ' || f || ' definition(s). Coverage state: evidence_found. {scoring.CLOSING}' END AS rationale,
concat_ws('|', CASE state WHEN 'insufficient_coverage' THEN '{scoring.ASK_COVERAGE}' WHEN 'no_evidence_in_searched_corpus' THEN '{scoring.ASK_NO_EVIDENCE}' END, CASE WHEN m <= 1 THEN '{scoring.ASK_MEMBERS}' END, CASE WHEN x = 0 AND pattern = 'conditional_regime' THEN '{scoring.ASK_EXCEPTIONS}' END, CASE WHEN f = 0 THEN '{scoring.ASK_DEFINITIONS}' END,
CASE WHEN expected <> pattern THEN printf('{scoring.ASK_PATTERN.replace("'", "''")}', pattern, expected) END) AS open_questions FROM p"""


@query(RECOMMENDED_SQL)
def layer2_recommendations(table):
    """Bands for each labelled document as a claim on its source; the items of the benchmark are the sources' criteria and examples. Coverage counts verified claims of 1,500 characters or more."""
    band = F.element_at(F.array(*map(F.lit, review.BANDS)), (F.floor(F.col("item_id") / 20) % 3 + 1).cast("int"))
    items = table("benchmark").groupBy(F.concat(F.lit("src"), F.col("item_id") % 20).alias("indicator_id"), band.alias("band")).agg(F.min("item_id").alias("ord"), F.min_by("text", "item_id").alias("text"))
    words, first = F.regexp_extract_all(F.lower("first"), F.lit("[a-z0-9]+"), F.lit(0)), F.col("first")
    criteria = F.map_from_entries(F.collect_list(F.struct("band", "text")))
    indicators = items.groupBy("indicator_id").agg(criteria.alias("criteria"), F.min_by("text", "ord").alias("first")).select(
        "indicator_id", F.col("indicator_id").alias("name"), "criteria", F.slice(words, 1, 2).alias("positive"), F.slice(words, 3, 2).alias("negative"), F.when(F.contains(first, F.lit("that")), "conditional_regime").when(F.contains(first, F.lit("ing")), "prohibition").alias("clause_pattern")
    )
    low = F.lower("text")
    status = review.layer1_status(F.col("quality") == 1, F.col("toxic") == 1)
    claims = table("documents").join(table("labels"), "doc_id").select(
        F.col("doc_id").alias("claim_id"), F.col("lang").alias("jurisdiction"), F.col("source").alias("indicator_id"), F.when(status == "pending_verification", "verified").otherwise(status).alias("status"), "text", "n_chars",
        F.when(F.contains(low, F.lit(" with ")), "conditional_regime").otherwise("prohibition").alias("clause_pattern"), F.size(F.split("text", "\n", -1)).alias("members"), (F.size(F.split(low, " not ", -1)) - 1).alias("exceptions"), (F.size(F.split(low, " is ", -1)) - 1).alias("definitions"),
    )
    counted = review.qualifying(claims).where("n_chars >= 1500")
    state = F.when(F.count_if((F.col("status") == "verified") & (F.col("n_chars") >= 1500)) > 0, "evidence_found").when(F.count(F.lit(1)) >= 2, "no_evidence_in_searched_corpus").otherwise("insufficient_coverage")
    coverage = claims.groupBy("jurisdiction", "indicator_id").agg(state.alias("state")).withColumn("reason", F.lit(None).cast("string"))
    examples = items.select("ord", F.col("indicator_id").alias("label"), "band", "text")
    found = scoring.recommendations(claims, indicators, coverage, counted, examples)
    return found.select("claim_id", F.coalesce("band", F.lit("null")).alias("band"), "rationale", F.array_join("open_questions", "|").alias("open_questions"))


TURN_WORDS = "SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations WHERE role = '{}'"


@query(f"""WITH u AS ({TURN_WORDS.format('user')}), a AS ({TURN_WORDS.format('assistant')}), k AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS question FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') > 0),
q AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS w FROM k), r AS (SELECT conv_id, avg(CASE WHEN a.w IS NULL THEN 0.0 ELSE 1.0 END) AS recall FROM u LEFT JOIN a USING (conv_id, w) GROUP BY 1), f AS (SELECT conv_id, avg(CASE WHEN a.w IS NULL THEN 0.0 ELSE 1.0 END) AS faith FROM q LEFT JOIN a USING (conv_id, w) GROUP BY 1)
SELECT conv_id, round(coalesce(recall, 0), 6) AS context_recall, round(coalesce(faith, 0), 6) AS faithfulness FROM k LEFT JOIN r USING (conv_id) LEFT JOIN f USING (conv_id)""")
def context_recall(table):
    """How many of a conversation's words, those of all its questions and of the first one, its answers hold; the answers are the passages."""
    turns = table("conversations")
    asked = turns.where("role = 'user'")
    pairs = asked.groupBy(F.col("conv_id").alias("claim_id")).agg(F.min_by("text", "turn").alias("constraint")).withColumn("gold_id", F.col("claim_id"))
    passages = turns.where("role = 'assistant'").select(F.col("conv_id").alias("claim_id"), "text")
    scored = review.passage_recall(pairs, asked.select(F.col("conv_id").alias("gold_id"), "text"), passages)
    return scored.select(F.col("claim_id").alias("conv_id"), F.round("context_recall", 6).alias("context_recall"), F.round("faithfulness", 6).alias("faithfulness"))


COMPONENTS = {"view": "crawl", "click": "ocr", "signup": "embedding", "purchase": "llm"}
COMPONENT_SQL = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in COMPONENTS.items()) + " ELSE event_type END"
PRICE_SQL = "(VALUES " + ", ".join(f"('{s}', '{c}', '{m}', {per}, {usd}::DOUBLE)" for s, c, m, per, usd in costs.PRICES) + ") AS p(stack, component, measure, per, usd)"


@query(f"""WITH e AS (SELECT {COMPONENT_SQL} AS component, event_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), s AS (SELECT component, count(*) AS events, sum(value) AS seconds, arg_min('m' || k, event_id) FILTER (k > 50) AS engine, sum(k) AS k, sum(k // 4) AS out FROM e GROUP BY 1),
c AS (SELECT component, stack, sum(CASE measure WHEN 'output_tokens' THEN out ELSE k END * 1.0::DOUBLE / per * usd) AS cost FROM s JOIN {PRICE_SQL} USING (component) GROUP BY ALL)
SELECT component, events, round(coalesce(seconds, 0), 4) AS seconds, coalesce(engine, '') AS engine, round(coalesce((SELECT cost FROM c WHERE c.component = s.component AND stack = 'current'), 0), 6) AS cost_usd, round(coalesce((SELECT cost FROM c WHERE c.component = s.component AND stack = 'open_weight'), 0), 6) AS cost_usd_open_weight FROM s""")
def cost_components(table):
    """Each kind of events as a component: its time, first engine and costs under both price tables."""
    kind = F.coalesce(*(F.when(F.col("event_type") == e, c) for e, c in COMPONENTS.items()), F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("long")
    spent = table("events").select(kind.alias("component"), F.col("event_id").alias("at"), F.col("value").alias("seconds"), F.when(k > 50, F.concat(F.lit("m"), k)).alias("engine"), k.alias("pages"), k.alias("tokens"), k.alias("input_tokens"), F.floor(k / 4).alias("output_tokens"))
    return costs.component_costs(spent).withColumns({"seconds": F.round("seconds", 4), "cost_usd": F.round("cost_usd", 6), "cost_usd_open_weight": F.round("cost_usd_open_weight", 6)})


@query("PIVOT (SELECT lang, source FROM documents WHERE source IS NOT NULL) ON source USING count(*) GROUP BY lang")
def coverage_matrix(table):
    """Documents of each language by source, with all sources as columns in the natural order of their numbers."""
    cells = table("documents").where("source is not null").groupBy("lang", "source").count()
    return review.grid(cells, "lang", "source", F.first("count")).na.fill(0)
