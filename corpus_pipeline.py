"""Corpus pipeline: quality, line and near-copy filters, the source mix, and encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each one's rows
as Parquet in the shared folder and reads them again as the next one's documents. All stages but
the last return the columns of ``docs``, whatever these are called beside ``doc_id``, ``text``,
``lang`` and ``source``. A null in any column, repeated rows and empty tables have a defined result
in each stage, stated there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrain.llm import linedup, mixing, nearcopies, pieces, quality, queries
from evigrain.llm.staging import staged

#: Words in a shingle, and the similarity of shingle sets from which texts are near copies.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null, empty and very short texts can't be judged and stay."""
    return quality.keep_good(docs, queries.trusted_ids(spark, sf_dir))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line is within one word of go; documents of which nothing remains go too.

    Null texts and rows with a null id stay as they are. Earlier is the smaller id. Rows that share
    their id with a row of another text come after all others, in an order of their own, and lose
    lines like them; equal rows lose the same lines.
    """
    name = max(docs.columns, key=len) + " line key"  # no column has this name
    rows = docs.withColumn(name, F.col("doc_id").cast("long"))
    several = docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(name + " id")).agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    several = staged(several.where("low <> high").select(name + " id"), "shared_ids")
    if not several.isEmpty():  # whole texts are joined only where there is something to tell apart
        own = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + F.lit(1 << 62)
        rows = docs.join(several, docs["doc_id"] == several[name + " id"], "left").withColumn(name, F.when(F.col(name + " id").isNotNull(), own).otherwise(F.col("doc_id").cast("long"))).drop(name + " id")
        rows = staged(rows, "keyed_rows")
    left = linedup.drop_lines(rows, linedup.removed_lines(rows, id_col=name, shortest=1), id_col=name, shortest=1).drop(name)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def _rows(docs: DataFrame) -> DataFrame:
    """``(row, key)``: each row whole, as a struct, so that no name can clash, and a hash of it. Equal rows have equal keys."""
    return docs.select(F.struct(*docs.columns).alias("row")).withColumn("key", F.xxhash64("row"))


def _one_of_each(rows: DataFrame) -> DataFrame:
    """One row of each key."""
    first = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return rows.withColumn("first", first).where("first = 1").drop("first")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the one with the smallest id, and a null id only if there is no other.

    Texts without words, null ones among them, are copies of each other, so one of them stays.
    Of repeated rows one stays.
    """
    rows = _rows(docs)
    groups = nearcopies.near_copy_groups(rows.select("key", F.col("row.text").alias("text")), id_col="key", width=SHINGLE_WORDS, similarity=SIMILARITY)
    ids = rows.select("key", F.col("row.doc_id").alias("id")).distinct()
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best")
    kept = staged(groups.distinct().join(ids, "key").groupBy("component_id").agg(best).select("best.key"), "kept")
    return _one_of_each(rows.join(kept, "key", "left_semi")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole: its taken words by its size, rounded, and none at 0.

    A document that is taken in part stays once. Repeated rows are separate documents of the mix,
    null ids count like any other, and null and empty texts, which have no words to take, go.
    """
    rows = _rows(docs)
    sizes = rows.select("key", F.col("row.text").alias("text"), F.col("row.source").alias("source"))
    taken = mixing.mix_sources(sizes, id_col="key").where("taken > 0")
    times = taken.groupBy("key").agg(F.sum(F.greatest(F.lit(1), F.round(F.col("taken") / F.col("size"))).cast("int")).alias("times"))
    return _one_of_each(rows.join(times, "key")).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests, a row for each row; null texts count as empty."""
    return queries.piece_digests(pieces.encode_documents(docs, queries.piece_model()))


STAGES = [("quality", keep_quality), ("lines", drop_repeated_lines), ("near_copies", keep_one_of_near_copies), ("mix", mix), ("encode", encode)]

#: Perplexity, fingerprints and encoding are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
