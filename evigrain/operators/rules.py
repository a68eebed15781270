"""Rule operators: keyword hits, hashed vectors, gates, coverage, bands, provisions, structure edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.functions import text as T
from evigrain.functions.tokenizer import token_rows
from evigrain.operators.elements import paragraphs

TOKEN = r"[\p{L}\p{N}_]{4,}"
GATES = ("span_existence", "verbatim_match", "entailment", "self_consistency")
#: Ranks of authority tiers, highest first.
AUTHORITY_RANK = {"tier_1_statute": 4, "tier_2_regulation": 3, "tier_3_guideline": 2, "tier_4_informal": 1}
#: The columns of an exported provision, in order.
PROVISION_COLUMNS = ["economy", "law_name", "law_number_ref", "last_amended", "indicator_id", "article", "discovery_tag", "location_reference", "verbatim_snippet", "mapping_rationale", "source_url", "confidence", "notes"]


def keyword_hits(docs: DataFrame, indicators: DataFrame) -> DataFrame:
    """Elements with a keyword of an indicator: ``(lang, indicator_id, doc_id, seq, element_id, score)``."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.lower("text"), "\n", -1)).alias("seq", "line"), "lang").where(F.trim("line") != "")
    met = rows.join(F.broadcast(indicators), T.has_keyword(F.col("line"), F.col("keywords")))
    scored = met.withColumn("score", T.keyword_score(F.col("line"), F.col("keywords")))
    return scored.select("lang", "indicator_id", "doc_id", "seq", F.concat_ws("_p", "doc_id", "seq").alias("element_id"), "score")


def coverage_state(evidence: Column, recall: Column) -> Column:
    """Three states, never a bare zero: evidence, none in a corpus of known recall, or too little coverage to tell."""
    return F.when(evidence, "evidence_found").when(recall.isNotNull(), "no_evidence_in_searched_corpus").otherwise("insufficient_coverage")


def miss_percent(recall: Column) -> Column:
    return F.bround((1 - recall) * 100).cast("int")


def with_completeness(state: Column, ratio: Column, least: float = 0.5) -> Column:
    return F.when(ratio < least, "insufficient_coverage").otherwise(state)


def defensible_zero(state: Column, recall: Column, reach: Column, least_recall: float = 0.8, least_reach: float = 0.9) -> Column:
    return (state == "no_evidence_in_searched_corpus") & (recall >= least_recall) & (reach >= least_reach)


def hashed_terms(rows: DataFrame, ident: str, lang: str | None = None) -> DataFrame:
    """Postings ``(ident, term, tf)`` of search tokens; ``lang`` names the column that picks the stopwords.

    A word is hashed once for each document. Two words of a document with the same term have a row each.
    """
    counts = token_rows(rows, [ident], "text", lang).groupBy(ident, "token").agg(F.count(F.lit(1)).alias("tf"))
    return counts.select(ident, T.hashed_term(F.col("token")).alias("term"), "tf")


def hashed_vectors(rows: DataFrame, ident: str, size: int = 64) -> DataFrame:
    """Signed hashed bags of words of unit length, ``(ident, v)``."""
    words = rows.select(ident, F.explode_outer(T.tokens(F.col("text"), TOKEN)).alias("t"))
    sums = words.groupBy(ident, F.coalesce(T.hashed_bucket(F.col("t"), size), F.lit(0)).alias("b")).agg(F.sum(F.when(F.col("t").isNotNull(), T.hashed_sign(F.col("t"))).otherwise(0.0)).alias("w"))
    norm = F.greatest(F.lit(1e-12), F.sqrt(F.sum(F.col("w") * F.col("w"))))
    raw = sums.groupBy(ident).agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"), norm.alias("n"))
    return raw.select(ident, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.col("n")).alias("v"))


def dense_scores(queries: DataFrame, query_id: str, rows: DataFrame, ident: str) -> DataFrame:
    """Dot products of every query with every row: ``(query_id, ident, score)``."""
    q = hashed_vectors(queries, query_id).withColumnRenamed("v", "q")
    return hashed_vectors(rows, ident).crossJoin(q).select(query_id, ident, F.round(T.dot(F.col("q"), F.col("v")), 9).alias("score"))


def made_up_spans(docs: DataFrame) -> DataFrame:
    """A span of each element, some of them out of bounds, and a stored snippet, some of them altered."""
    rows = paragraphs(docs)
    start = (F.col("doc_id") * 7 + F.col("seq")) % 40
    rows = rows.withColumn("a", start.cast("int")).withColumn("b", (start + 5 + F.col("seq") % 60).cast("int"))
    cut = F.substring("text", F.col("a") + 1, F.col("b") - F.col("a"))
    return rows.withColumn("snippet", F.when(F.col("seq") % 11 == 3, F.upper(cut)).otherwise(cut))


def gates() -> dict[str, Column]:
    """Span and verbatim gates; the two model gates by a stand-in on the element's length."""
    n = F.length("text")
    cut = F.substring("text", F.col("a") + 1, F.col("b") - F.col("a"))
    return {"span_existence": (F.col("a") < F.col("b")) & (F.col("b") <= n), "verbatim_match": (F.col("b") <= n) & (cut == F.col("snippet")), "entailment": n % 7 > 0, "self_consistency": n % 5 > 0}


def status_of(existence: Column, verbatim: Column, entailment: Column, consistency: Column) -> Column:
    """A failed deterministic gate rejects, a failed model gate flags."""
    return F.when(~(existence & verbatim), "rejected").when(~(entailment & consistency), "flagged").otherwise("verified")


def first_match(value: Column, patterns: list[tuple[str, str]], default: str) -> Column:
    """What the first matching pattern says; patterns are a small configured list."""
    return F.coalesce(*(F.when(value.rlike(p), tier) for p, tier in patterns), F.lit(default))


def authority_rank(tier: Column) -> Column:
    found = F.when(F.lit(False), 0)
    for name, rank in AUTHORITY_RANK.items():
        found = found.when(tier == name, rank)
    return found


def queue_rank(state: Column) -> Column:
    found = F.when(F.lit(False), 0)
    for rank, name in enumerate(("no_evidence", "insufficient", "flagged", "rejected")):
        found = found.when(state == name, rank)
    return found.when(state == "verified", 5).otherwise(4)


def band_scores(text: Column, criteria: dict[str, list[str]], positive: list[str], negative: list[str]) -> list[Column]:
    """Scores of the bands 0, 0.5 and 1: overlap with the criteria, keywords raise all, cues move 1 to 0.5."""
    low = F.lower(text)
    words = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)))
    count = lambda values: sum((F.when(F.contains(low, F.lit(v)), 1).otherwise(0) for v in values), F.lit(0))
    overlap = lambda band: F.size(F.array_intersect(words, T.array_of(criteria[band])))
    pos, neg = count(positive) * 0.25, count(negative)
    return [(overlap("0") + pos).cast("double"), (overlap("0.5") + pos + neg * 0.25).cast("double"), (overlap("1") + pos - neg * 0.5).cast("double")]


def band_pick(zero: Column, half: Column, one: Column) -> Column:
    """The best band; 0.5 where nothing scores or the margin is under one half."""
    ranked = F.sort_array(F.array(zero, half, one), asc=False)
    top, margin = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))
    return F.when((top <= 0) | (margin < 0.5), "0.5").when(zero == top, "0").when(half == top, "0.5").otherwise("1")


def violations(provisions: DataFrame) -> DataFrame:
    """``(doc_id, violation)`` for each conformance rule that a row breaks."""
    required = [c for c in PROVISION_COLUMNS if c in ("economy", "law_name", "law_number_ref", "indicator_id", "article", "verbatim_snippet", "source_url")]
    checks = [F.when(F.trim(c) == "", f"missing {c}") for c in required]
    checks += [F.when(~F.col("discovery_tag").isin("NEW", "KNOWN"), "bad discovery_tag"), F.when((F.col("article") != "") & ~F.col("article").rlike(r"\("), "article lacks paragraph"), F.when(F.length("mapping_rationale") > 300, "long rationale")]
    checks += [F.when(F.try_to_number("confidence", F.lit("9.99")) > 1, "confidence above 1"), F.when(~F.col("indicator_id").rlike(r"^P\d+-I\d+$"), "bad indicator_id")]
    return provisions.select("doc_id", F.explode(F.array_compact(F.array(*checks))).alias("violation"))
