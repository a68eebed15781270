"""Sinks: the 13-column CSV, the JSON evidence package, keyed merges and append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.operators.relational import latest
from evigrain.operators.rules import PROVISION_COLUMNS


def _cell(name: str) -> Column:
    """A cell, quoted only if it holds a comma, a quote or a line end."""
    value = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.when(value.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def write_csv(provisions: DataFrame, path: str, one_file: bool = False) -> None:
    """Parts with CRLF line ends, the first of them the header, that make the CSV file in the order of their names; ``one_file`` makes one task write it all.

    Line ends within cells stay as they are, which Spark's own CSV writer would change.
    """
    rows = provisions.select(F.concat_ws(",", *map(_cell, PROVISION_COLUMNS)).alias("value"), F.monotonically_increasing_id().alias("place"))
    head = provisions.sparkSession.createDataFrame([(",".join(PROVISION_COLUMNS), -1)], "value string, place long").coalesce(1)
    whole = head.unionByName(rows)
    if one_file:  # joined partitions come in any order
        whole = whole.coalesce(1).sortWithinPartitions("place")
    whole.select("value").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def provision_json(provisions: DataFrame) -> DataFrame:
    return provisions.select(F.to_json(F.struct(*PROVISION_COLUMNS)).alias("value"))


def write_json(provisions: DataFrame, path: str) -> None:
    provisions.select(*PROVISION_COLUMNS).write.mode("overwrite").json(path)


def submission_summary(provisions: DataFrame, violations: DataFrame) -> DataFrame:
    """Rows, NEW and KNOWN ones, and violations of a submission."""
    counts = provisions.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("discovery_tag") == "NEW").alias("new"), F.count_if(F.col("discovery_tag") == "KNOWN").alias("known"))
    return counts.crossJoin(violations.agg(F.count(F.lit(1)).alias("violations")))


def without_nul(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.replace(F.col(c), F.lit("\0"), F.lit("")) for c, kind in rows.dtypes if kind == "string"})


def merged(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in the place of those with equal keys, nulls equal to each other; NUL characters are dropped, also in keys. Columns that one side lacks are null there."""
    clean = without_nul(new)
    there = clean.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keys)))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    return clean.unionByName(old.join(there, same, "left_anti"), allowMissingColumns=True)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def latest_report(gates: DataFrame, required: list[str]) -> DataFrame:
    """The last row of each gate of a claim; claims without all ``required`` gates have none."""
    last = latest(gates, ["claim_id", "gate"], [F.desc("ran_at"), F.desc("id")])
    whole = last.groupBy("claim_id").agg(F.collect_set("gate").alias("there")).where(F.size(F.array_except(F.array(*map(F.lit, required)), "there")) == 0)
    return last.join(whole.select("claim_id"), "claim_id", "left_semi")


def citations(spans: DataFrame, elements: DataFrame, documents: DataFrame) -> DataFrame:
    """Spans with their element's snippet and document, as a citation; spans without either are left out."""
    joined = spans.join(elements, "element_id").join(documents, "doc_id")
    cut = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    snippet = F.coalesce(F.nullif(cut, F.lit("")), F.col("text"))
    label = F.concat("title", F.lit(", "), F.coalesce("numbering", "element_id"), F.when(F.col("page").isNotNull(), F.concat(F.lit(", p. "), "page")).otherwise(""))
    return joined.select("claim_id", "doc_id", "element_id", snippet.alias("snippet"), label.alias("citation"))
