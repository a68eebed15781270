"""Spans over texts: disjoint segments with the spans that cover them, and marked texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.operators.relational import merged_intervals

#: Signs with a meaning in HTML, the ampersand first.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]


def escaped(text: Column) -> Column:
    for sign, name in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def clamped(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """``(doc_id, span_id, char_start, char_end)`` within the text; spans that are empty then, and those of unknown or null texts, go."""
    sizes = texts.select("doc_id", F.length("text").alias("size")).where("size is not null")
    inside = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col("size"))).cast("int").alias(c)
    return spans.join(sizes, "doc_id").select("doc_id", "span_id", inside("char_start"), inside("char_end")).where("char_end > char_start")


def segments(spans: DataFrame) -> DataFrame:
    """``(doc_id, char_start, char_end, span_ids)``: the stretches between the bounds of a document's spans that any span covers, with all that cover them.

    Bounds are numbered in each document; a span finds its first and last number by joins on its
    bounds and gives a row for each number between, so rows arise only for spans that do cover.
    """
    bounds = spans.select("doc_id", F.explode(F.array("char_start", "char_end")).alias("at")).distinct()
    order = Window.partitionBy("doc_id").orderBy("at")
    bounds = bounds.select("doc_id", "at", F.row_number().over(order).alias("place"), F.lead("at").over(order).alias("after"))
    first, last = (bounds.select("doc_id", F.col("at").alias(c), F.col("place").alias(name)) for c, name in (("char_start", "low"), ("char_end", "high")))
    covered = spans.join(first, ["doc_id", "char_start"]).join(last, ["doc_id", "char_end"]).select("doc_id", "span_id", F.explode(F.sequence("low", F.col("high") - 1)).alias("place"))
    ids = covered.groupBy("doc_id", "place").agg(F.array_sort(F.collect_set("span_id")).alias("span_ids"))
    return ids.join(bounds, ["doc_id", "place"]).select("doc_id", F.col("at").alias("char_start"), F.col("after").alias("char_end"), "span_ids")


def marked_texts(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``(doc_id, html, marks)``: the escaped text with ``<mark>`` around what spans cover, touching ones together; texts without spans are only escaped, null ones null."""
    merged = merged_intervals(clamped(spans, texts), ["doc_id"], "char_start", "char_end")
    found = merged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end"))).alias("at"))
    rows = texts.select("doc_id", "text").join(found, "doc_id", "left").withColumn("at", F.coalesce("at", F.array().cast("array<struct<char_start:int,char_end:int>>")))
    cut = lambda a, b: escaped(F.substring(F.col("text"), a + 1, b - a))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("at", i - 1)["char_end"])
    parts = F.transform("at", lambda x, i: F.concat(cut(before(i), x["char_start"]), F.lit("<mark>"), cut(x["char_start"], x["char_end"]), F.lit("</mark>")))
    end = F.coalesce(F.try_element_at("at", F.lit(-1))["char_end"], F.lit(0))
    return rows.select("doc_id", F.concat(F.array_join(parts, ""), cut(end, F.length("text"))).alias("html"), F.size("at").alias("marks"))
