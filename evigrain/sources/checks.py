"""Checked rows: rules as data that give a row for each broken path, expected types with defaults, and keyed tables that replace rows whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from evigrain.operators.export import merged, without_nul
from evigrain.operators.relational import latest
from evigrain.operators.rules import AUTHORITY_RANK

#: Types that a law's corpus is expected to hold where no manifest says otherwise.
DEFAULT_TYPES = ["statute", "regulation"]
TIERS = list(AUTHORITY_RANK)
OVERRIDE_KEY = ["jurisdiction", "source_pattern"]


def _broken(path: str, kind: str, argument: object) -> tuple[Column, Column]:
    """Whether a value breaks a rule, and the message. Only ``required`` speaks of nulls."""
    value = F.col(path)
    text = value.cast("string")
    if kind == "required":
        return F.coalesce(F.trim(text), F.lit("")) == "", F.lit("missing")
    if kind == "one_of":
        return ~text.isin([str(a) for a in argument]), F.concat(F.lit("not allowed: "), text)
    if kind == "pattern":
        return ~text.rlike(argument), F.concat(F.lit("malformed: "), text)
    if kind == "at_least":
        return value < F.lit(argument), F.concat(F.lit("too small: "), text)
    if kind == "at_most":
        return value > F.lit(argument), F.concat(F.lit("too large: "), text)
    if kind == "each":
        return F.exists(value, lambda v: ~v.cast("string").isin([str(a) for a in argument])), F.lit("holds a value that is not allowed")
    raise ValueError(f"no rule of kind {kind!r}")


def violations(rows: DataFrame, ident: list[str], rules: list[tuple[str, str, object]]) -> DataFrame:
    """``(*ident, path, message)``: a row for each rule ``(path, kind, argument)`` that a row breaks.

    Kinds: ``required`` (null or blank breaks it), ``one_of``, ``pattern``, ``at_least``,
    ``at_most``, ``each`` (arrays) and ``unique``, whose path is a list of columns parted by commas:
    every row but the first, by ``ident``, of those with equal values breaks it; nulls are equal.
    Null values break no other rule. Nested fields are named with dots. A table without rows has no
    violations; all rules but ``unique`` are read in one pass, and an unknown kind is an error.
    """
    single = [(path, *_broken(path, kind, argument)) for path, kind, argument in rules if kind != "unique"]
    parts = [F.when(bad, F.struct(F.lit(path).alias("path"), message.alias("message"))) for path, bad, message in single]
    found = [rows.select(*ident, F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("x")).select(*ident, "x.*")] if parts else []
    for path in (path for path, kind, _ in rules if kind == "unique"):
        keys, key = [c.strip() for c in path.split(",")], F.struct(*ident).alias("_id")
        many = rows.groupBy(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keys))).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(keys)))
        repeated = rows.join(many, same).where(F.struct(*ident) != F.col("_first"))
        found.append(repeated.select(*ident, F.lit(path).alias("path"), F.lit("repeated").alias("message")))
    return reduce(DataFrame.unionByName, found)


def expected_types(cells: DataFrame, manifest: DataFrame, default: list[str] | None = None) -> DataFrame:
    """``(jurisdiction, indicator, document_type, given)`` that each cell ``(jurisdiction, indicator)`` is expected to hold.

    A cell's own rows of ``manifest (jurisdiction, indicator, document_type)`` count; without any,
    the rows of its jurisdiction with a null indicator; without these, ``default``. ``given`` says
    which: ``indicator``, ``jurisdiction`` or ``default``.
    """
    cells = cells.select("jurisdiction", "indicator").distinct()
    types = F.array_sort(F.collect_set("document_type"))
    own = manifest.where(F.col("indicator").isNotNull()).groupBy("jurisdiction", "indicator").agg(types.alias("own"))
    general = manifest.where(F.col("indicator").isNull()).groupBy("jurisdiction").agg(types.alias("general"))
    both = cells.join(own, ["jurisdiction", "indicator"], "left").join(general, "jurisdiction", "left")
    given = F.when(F.col("own").isNotNull(), "indicator").when(F.col("general").isNotNull(), "jurisdiction").otherwise("default")
    chosen = F.coalesce("own", "general", F.array(*map(F.lit, default or DEFAULT_TYPES)))
    return both.select("jurisdiction", "indicator", F.explode(chosen).alias("document_type"), given.alias("given"))


def override_violations(rows: DataFrame, ident: str) -> DataFrame:
    """What is wrong with authority overrides: missing fields, unknown tiers, repeated ``(jurisdiction, source_pattern)``."""
    needed = [(c, "required", None) for c in [*OVERRIDE_KEY, "authority_tier", "rationale"]]
    return violations(rows, [ident], [*needed, ("authority_tier", "one_of", TIERS), (",".join(OVERRIDE_KEY), "unique", None)])


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """The table's last whole version; None before the first."""
    try:
        last = spark.read.schema("version long, merge_id string").parquet(f"{path}/versions").agg(F.max("version")).first()[0]
    except AnalysisException:
        return None
    return None if last is None else spark.read.parquet(f"{path}/data/version={last}")


def merge_keyed(new: DataFrame, path: str, keys: list[str], order: list[str], merge_id: str) -> DataFrame:
    """Put the rows of ``new`` in the place of those with equal keys in the table at ``path``; gives the table after it.

    Of rows of ``new`` with equal keys the last by ``order`` counts, so ``order`` has to be total
    within a key. Null keys are equal to each other. NUL characters are dropped. A version is
    written to a folder of its own and counts once its row in ``versions`` is written, so readers
    see the old table or the new one. Tasks may be repeated: Spark commits one attempt of each. A
    merge that broke off is written over, and one whose ``merge_id`` is already there changes
    nothing. One writer at a time.
    """
    spark = new.sparkSession
    old = read_keyed(spark, path)
    last = 0
    if old is not None:
        done = spark.read.schema("version long, merge_id string").parquet(f"{path}/versions")
        if not done.where(F.col("merge_id") == merge_id).isEmpty():
            return old
        last = done.agg(F.max("version")).first()[0]
    rows = latest(without_nul(new), keys, [F.col(c).desc_nulls_last() for c in order])
    whole = merged(rows, rows.limit(0) if old is None else old, keys)
    whole.write.mode("overwrite").parquet(f"{path}/data/version={last + 1}")
    spark.createDataFrame([(last + 1, merge_id)], "version long, merge_id string").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return read_keyed(spark, path)
