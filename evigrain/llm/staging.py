"""Staging of intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only where it is unset, as in tests on a
local master, a folder of our own is used.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; on a cluster it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="spark-staging-"))
    return "file://" + _local_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The bit set has eight bits for each wanted key, and no more than 2**25: 4 MB.
SIEVE_BITS = 10, 25


def sieved(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``df`` with every row whose ``key`` is among ``wanted``'s first column, and few or some others.

    A bit set of hashed keys, of 4 MB at most, is broadcast, so rows that a later join would drop
    need no shuffle. A null key is never wanted. Where so many keys are wanted that most bits are
    set, more of the other rows stay; the join that follows decides in any case.
    """
    wanted = wanted.select(F.col(wanted.columns[0]).alias("wanted"))
    bits = min(SIEVE_BITS[1], max(SIEVE_BITS[0], math.ceil(math.log2(8 * max(1, wanted.count())))))
    bit = lambda column: F.xxhash64(column).bitwiseAND(F.lit((1 << bits) - 1))
    word, place = (lambda column: F.shiftright(bit(column), 6)), (lambda column: bit(column).bitwiseAND(F.lit(63)).cast("int"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place("wanted"))
    found = wanted.groupBy(word("wanted").alias("the word")).agg(F.bit_or(one).alias("the bits"))
    met = df.join(F.broadcast(found), word(key) == F.col("the word"))
    there = F.call_function("shiftrightunsigned", F.col("the bits"), place(key)).bitwiseAND(F.lit(1)) == 1
    return met.where(there & F.col(key).isNotNull()).select(*(F.col(f"`{c}`") for c in df.columns))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    Returns ``(node, root)`` for every node that has an edge to another one; ``root`` is the
    smallest node of its component. Self loops, nulls and repeated edges change nothing; no
    edges give no rows. Each round moves as many rows as there are edges, a node's minimum is
    combined before the shuffle, and each round's edges are staged. So are the minima: a join with
    a staged table is one whose large keys Spark can split, a join on an aggregation is not.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = staged(edges.where(F.col(a) != F.col(b)).select(u, v).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = staged(large, "large")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        now = staged(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
