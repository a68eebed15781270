"""Statute texts to blocks: blank-line blocks with offsets, heading classes, sub-paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = r"\n\s*\n"
#: What the first line of a heading begins with, and what opens a sub-paragraph.
HEADINGS = {"chapter": r"(?i)^chapter\s+", "section": r"(?i)^(section|sec\.?|s\.)\s+\d+", "article": r"(?i)^(article|art\.?)\s+\d+"}
OPENS_SUB = r"^\s*\((\d+|[a-z]+)\)(\s|$)"


def text_blocks(docs: DataFrame) -> DataFrame:
    """``(doc_id, block, char_start, char_end, text)``: what stands between blank lines, with its offsets; blank blocks are left out.

    Offsets are sums of the lengths before a block, taken over a document's rows, so a long text
    costs no more than its length.
    """
    pieces, gaps = F.split("text", BLANK, -1), F.regexp_extract_all("text", F.lit(f"({BLANK})"), F.lit(1))
    both = F.zip_with(pieces, gaps, lambda p, g: F.struct(p.alias("text"), F.coalesce(F.length(g), F.lit(0)).alias("gap")))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(both).alias("at", "piece")).select("doc_id", "at", "piece.text", "piece.gap")
    upto = F.sum(F.length("text") + F.col("gap")).over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("char_start", (upto - F.length("text") - F.col("gap")).cast("int")).where(F.col("text").rlike(r"\S"))
    block = (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).alias("block")
    return rows.select("doc_id", block, "char_start", (F.col("char_start") + F.length("text")).alias("char_end"), "text")


def heading_class(block: Column) -> Column:
    """``chapter``, ``section``, ``article`` or null, by the block's first line."""
    first = F.trim(F.get(F.split(block, "\n"), F.lit(0)))
    return F.coalesce(*(F.when(first.rlike(p), name) for name, p in HEADINGS.items()))


def sub_paragraphs(blocks: DataFrame) -> DataFrame:
    """``(doc_id, block, part, text)``: a part begins at a line that opens with a number or letter in brackets; other lines go on with it."""
    lines = blocks.select("doc_id", "block", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    inside = Window.partitionBy("doc_id", "block").orderBy("at")
    opens = F.when(F.col("line").rlike(OPENS_SUB) & (F.col("at") > 0), 1).otherwise(0)
    lines = lines.withColumn("part", F.sum(opens).over(inside))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("doc_id", "block", "part").agg(text.alias("text"))
