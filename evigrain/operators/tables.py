"""Rows and cells of table elements with offsets, and routes of elements by their type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What parts the cells of a line, the first that the line holds.
SEPARATORS = ["\t", " | ", "|"]
#: The route of an element by its type.
ROUTES = {"clause_extraction": ["paragraph", "section", "article", "list_item", "definition", "schedule"], "tabular_lookup": ["table", "table_cell"]}


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def table_parts(elements: DataFrame) -> DataFrame:
    """``(doc_id, element_id, parent_id, element_type, numbering, char_start, char_end, text)`` of the rows and cells of tables that have no children.

    ``elements`` are ``(doc_id, element_id, parent_id, element_type, char_start, text)``. A row is a
    line with a cell; cells stand between tabs, else between bars, else the line is one, without
    white space around them, and blank ones are left out. Ids are ``<table>.rN`` and
    ``<table>.rN.cM``, both from 0. Offsets cut a row or cell out of the table's text, begun at the
    table's ``char_start``. They are sums over a table's lines and a line's cells, so long tables
    cost no more than their length. Null texts have no rows.
    """
    parents = elements.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("element_id")).distinct()
    tables = elements.where("element_type = 'table'").join(parents, ["doc_id", "element_id"], "left_anti")
    lines = tables.select("doc_id", "element_id", F.col("char_start").alias("begin"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    order = Window.partitionBy("doc_id", "element_id").orderBy("line_no")
    lines = lines.withColumn("begin", F.col("begin") + F.sum(F.length("line") + 1).over(order) - F.length("line") - 1).where(F.col("line").rlike(r"[^\s|]|^[^\t|]*\S"))
    pieces, gap = F.array("line"), F.lit(0)
    for sign in reversed(SEPARATORS):
        held = F.contains("line", F.lit(sign))
        pieces, gap = F.when(held, F.split("line", sign.replace("|", r"\|"), -1)).otherwise(pieces), F.when(held, len(sign)).otherwise(gap)
    cells = lines.select("doc_id", "element_id", "line_no", "line", "begin", gap.alias("gap"), F.posexplode(pieces).alias("at", "piece"))
    inside = Window.partitionBy("doc_id", "element_id", "line_no").orderBy("at")
    lead = F.length(F.regexp_extract("piece", r"^\s*", 0))
    cells = cells.withColumn("start", F.col("begin") + F.sum(F.length("piece") + F.col("gap")).over(inside) - F.length("piece") - F.col("gap") + lead).withColumn("text", _bare(F.col("piece"))).where("text <> ''")
    cells = cells.withColumn("column", F.row_number().over(inside) - 1).withColumn("row", F.dense_rank().over(order) - 1)
    row_id = F.concat("element_id", F.lit(".r"), "row")
    numbering = F.concat(F.lit("row:"), "row")
    row = F.struct(row_id.alias("id"), F.col("element_id").alias("parent_id"), F.lit("other").alias("element_type"), numbering.alias("numbering"), F.col("begin").alias("char_start"), F.col("line").alias("text"))
    cell = F.struct(F.concat(row_id, F.lit(".c"), "column").alias("id"), row_id.alias("parent_id"), F.lit("table_cell").alias("element_type"), F.concat(numbering, F.lit(";col:"), "column").alias("numbering"), F.col("start").alias("char_start"), F.col("text").alias("text"))
    found = cells.select("doc_id", F.explode(F.when(F.col("column") == 0, F.array(row, cell)).otherwise(F.array(cell))).alias("x"))
    start = F.col("x.char_start").cast("int")
    return found.select("doc_id", F.col("x.id").alias("element_id"), "x.parent_id", "x.element_type", "x.numbering", start.alias("char_start"), (start + F.length("x.text")).alias("char_end"), "x.text")


def route_tag(element_type: Column, existing: Column) -> Column:
    """``route:<name>`` after a bar behind what stands there; a route that stands there stays, and types without a route change nothing."""
    route = F.lit(None).cast("string")
    for name, types in ROUTES.items():
        route = F.when(element_type.isin(types), f"route:{name}").otherwise(route)
    bare = F.coalesce(existing, F.lit("")) == ""
    return F.when(route.isNull() | F.coalesce(F.contains(existing, F.lit("route:")), F.lit(False)), existing).when(bare, route).otherwise(F.concat(existing, F.lit("|"), route))
