"""Submissions: provision rows from claims and what is known of their elements, documents and sources, and the package that carries them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.functions import text as T
from evigrain.operators import export, rules

RATIONALE_CHARS = 300
#: Fields of a provision that only the JSON package carries, with their types and what they hold unless given.
EXTENDED = [
    ("source_pdf_path", "string", ""), ("ocr_quality_cer", "double", None), ("processing_time_seconds", "double", None), ("pdf_is_scanned", "boolean", False),
    ("retrieval_method", "string", "hybrid_parent_document"), ("raw_context_before", "string", ""), ("raw_context_after", "string", ""),
]


def _slice(text: Column, start: Column, end: Column) -> Column:
    """Half-open, from ``start`` on, which isn't negative; offsets beyond the text cut nothing."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def snippet(text: Column, element_start: Column, start: Column, end: Column) -> Column:
    """The text of a span, by offsets in its element or, where these don't fit, in the document; the whole element without a span or where neither cuts anything. Spaces around it go."""
    fits = (start >= 0) & (start < end) & (end <= F.length(text))
    begin = F.greatest(F.lit(0), start - element_start)
    within = _slice(text, begin, F.greatest(begin, end - element_start))
    found = F.when(start.isNull() | end.isNull(), text).when(fits, _slice(text, start, end)).otherwise(F.coalesce(F.nullif(within, F.lit("")), text))
    return F.regexp_replace(found, r"^\s+|\s+$", "")


def provision_records(claims: DataFrame, elements: DataFrame, documents: DataFrame, sources: DataFrame, reports: DataFrame, tags: DataFrame) -> DataFrame:
    """One row of the 13 columns, led by ``claim_id``, for each claim whose report doesn't reject it.

    Claims are ``(claim_id, jurisdiction, indicator_id, clause_id, spans array<struct<doc_id,
    char_start, char_end>>, subject, constraint, model_confidence)``; the first span counts. Elements
    are ``(element_id, text, char_start, numbering, page)``, documents ``(doc_id, title,
    source_url)``, sources ``(source_id, title, law_number_ref, last_amended, source_url)``, reports
    ``(claim_id, status)``, tags ``(claim_id, discovery_tag)``; each has one row for a key.
    What is missing falls back: a title to the source's title and the document's id, a law number to
    the source's title, an address to the source's, a tag to NEW, a status to pending. The snippet
    is cut at the first join, so no later one carries an element's text. Documents and sources are
    narrow; a document with a third of all claims is split by adaptive execution.
    """
    span = F.get("spans", F.lit(0))
    rows = claims.join(reports.select("claim_id", F.col("status").alias("layer1")), "claim_id", "left").where("layer1 is null or layer1 <> 'rejected'")
    rows = rows.select(
        "claim_id", "jurisdiction", "indicator_id", "clause_id", "layer1", "model_confidence", span["char_start"].alias("a"), span["char_end"].alias("b"), F.coalesce(span["doc_id"].cast("string"), F.col("clause_id").cast("string")).alias("doc"),
        F.concat(F.coalesce("subject", F.lit("")), F.lit(": "), F.coalesce("constraint", F.lit(""))).alias("why"),
    )
    own = elements.select(F.col("element_id").alias("clause_id"), "text", F.col("char_start").alias("begin"), "numbering", "page")
    met = rows.join(own, "clause_id", "left").withColumn("snippet", snippet(F.col("text"), F.col("begin"), F.col("a"), F.col("b")))
    place = F.coalesce(F.nullif("numbering", F.lit("")), F.concat(F.lit("para "), F.substring_index("clause_id", "_", -1)))
    met = met.withColumn("article", F.when(F.col("text").isNotNull(), place)).drop("text", "begin", "numbering")
    laws = documents.select(F.col("doc_id").cast("string").alias("doc"), F.col("title").alias("title"), F.col("source_url").alias("url"))
    known = sources.select(F.col("source_id").cast("string").alias("doc"), F.col("title").alias("source_title"), "law_number_ref", "last_amended", F.col("source_url").alias("source_url_"))
    met = met.join(laws, "doc", "left").join(known, "doc", "left").join(tags.select("claim_id", "discovery_tag"), "claim_id", "left")
    filled = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c), F.lit(""))
    return met.select(
        "claim_id", F.coalesce("jurisdiction", F.lit("")).alias("economy"), F.coalesce("title", "source_title", "doc", F.lit("")).alias("law_name"), filled("law_number_ref", "source_title").alias("law_number_ref"), filled("last_amended").alias("last_amended"),
        F.coalesce(_display(F.col("indicator_id")), F.lit("")).alias("indicator_id"), F.coalesce("article", F.lit("")).alias("article"), F.coalesce("discovery_tag", F.lit("NEW")).alias("discovery_tag"),
        F.coalesce(F.when(F.col("page") > 0, F.concat(F.lit("page "), "page")), F.lit("")).alias("location_reference"), F.coalesce("snippet", F.lit("")).alias("verbatim_snippet"), F.left("why", F.lit(RATIONALE_CHARS)).alias("mapping_rationale"),
        filled("url", "source_url_").alias("source_url"), F.coalesce(F.when(F.col("model_confidence").isNotNull(), F.format_string("%.2f", F.col("model_confidence"))), F.lit("")).alias("confidence"),
        F.concat(F.lit("layer1_status="), F.coalesce("layer1", F.lit("pending_verification"))).alias("notes"),
    )


def _display(ident: Column) -> Column:
    """``6.4`` and ``P6-I4`` as ``P6-I4``; other shapes stay, so that conformance reports them."""
    return F.coalesce(T.display_indicator(ident), ident)


def decimal_indicator(display: Column) -> Column:
    """``P6-I4`` as ``6.4``; other shapes stay."""
    pattern = r"^P(\d+)-I(\d+)$"
    return F.when(display.rlike(pattern), F.concat(F.regexp_extract(display, pattern, 1), F.lit("."), F.regexp_extract(display, pattern, 2))).otherwise(display)


def extended(provisions: DataFrame) -> DataFrame:
    """The 13 columns, the decimal indicator and the fields that only JSON carries; of the latter, columns that ``provisions`` has are kept, nulls too."""
    more = [F.col(name).cast(kind).alias(name) if name in provisions.columns else F.lit(value).cast(kind).alias(name) for name, kind, value in EXTENDED]
    return provisions.select(*rules.PROVISION_COLUMNS, decimal_indicator(F.col("indicator_id")).alias("indicator_id_decimal"), *more)


def submission_stem(economy: str, pillars: list[str], stamp: str) -> str:
    return f"{economy}_P{'-'.join(pillars)}_{stamp}"


def package_head(provisions: DataFrame, costs: DataFrame, economy: str, pillars: list[str], stamp: str, model: str) -> DataFrame:
    """The one row that leads a package: names, counts of provisions, NEW and KNOWN ones, and the costs ``(metric, value)`` whose value is a number."""
    of = lambda tag: F.count_if(F.col("discovery_tag") == tag)
    counts = provisions.agg(F.struct(F.count(F.lit(1)).alias("provisions"), of("NEW").alias("new"), of("KNOWN").alias("known")).alias("counts"))
    number = F.col("value").try_cast("double")
    numeric = costs.where(number.isNotNull()).groupBy("metric").agg(F.max(number).alias("number"))
    paid = numeric.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "number")))).alias("cost"))
    names = [F.lit(economy).alias("economy"), F.array(*map(F.lit, pillars)).cast("array<string>").alias("pillar_ids"), F.lit(stamp).alias("generated_at"), F.lit(model).alias("model_version")]
    return counts.crossJoin(paid).select(*names, "counts", "cost")


def write_submission(provisions: DataFrame, costs: DataFrame, folder: str, economy: str, pillars: list[str], stamp: str, model: str = "none") -> DataFrame:
    """Write ``<stem>.csv`` and ``<stem>.json`` into ``folder`` and return the summary row with their names.

    Both are folders of parts: the CSV's begin with its header and follow each other in the order of
    their names; the JSON has the package's head in ``head`` and a line for each provision in
    ``provisions``. A package of any size is written by as many tasks as its rows have partitions.
    """
    stem = submission_stem(economy, pillars, stamp)
    export.write_csv(provisions, f"{folder}/{stem}.csv")
    package_head(provisions, costs, economy, pillars, stamp, model).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{stem}.json/head")
    extended(provisions).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{stem}.json/provisions")
    broken = rules.violations(provisions.withColumnRenamed("claim_id", "doc_id"))
    return export.submission_summary(provisions, broken).select(F.lit(f"{stem}.csv").alias("csv"), F.lit(f"{stem}.json").alias("json"), "*")
