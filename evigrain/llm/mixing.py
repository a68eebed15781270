"""Mixing of sources to target weights by a low-discrepancy schedule.

Each source's documents are laid end to end in a shuffled order, on a line of words that repeats
for every epoch and is cut into blocks of equal length. Slot ``n`` of the schedule goes to the
source whose share of the cumulative weights holds the fractional part of ``n`` times the golden
ratio; the k-th slot of a source takes its k-th block, so the sequence decides how many blocks, and
which documents, a source gives. Its low discrepancy keeps that within a few blocks of the target,
and sources interleaved as evenly as their weights allow in every stretch of the mix. No random
state is kept, so reruns agree.

Only DataFrame functions are used. Running sums and ranks are made in two levels (within a bucket
or chunk, and over the sums of those), so no source's rows have to meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.llm.staging import staged

GOLDEN = 0.6180339887498949
#: A mix has so many slots, unless that would make its blocks longer than BLOCK_WORDS.
SLOTS = 1 << 18
BLOCK_WORDS = 1024
MAX_EPOCHS = 3
CHUNK_SLOTS = 1024
CELLS = 4096


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in ``text``; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, rank, source_size, target, quota)`` from rows ``(source, size)``.

    Sources by code point, null last, get the repeating ``weights`` and share the sum of all
    sizes. A target stops at ``max_epochs`` times its source's size; what is over goes to the
    others by weight: with sources in order of cap by weight, the first one whose cap is no lower
    than its share of what the capped ones leave sets the level.
    """
    ranked, capped = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("cap_by_weight", "rank")
    found = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(ranked))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("cap_by_weight", F.col("cap") / F.col("weight"))
    )
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - (F.sum("cap").over(capped) - F.col("cap"))
    weight = F.sum("weight").over(every) - (F.sum("weight").over(capped) - F.col("weight"))
    found = found.withColumn("level", left / weight)
    found = found.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap_by_weight"), F.struct("cap_by_weight", "rank", "level"))).over(every)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return found.withColumn("target", target).select("source", "rank", "source_size", "target", F.least("cap", F.round("target").cast("long")).alias("quota"))


def word_line(docs: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Each document's place on its source's shuffled line of words: ``begin`` and its number in the bucket."""
    shuffled = docs.join(targets, docs["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    shuffled = shuffled.withColumn("key", F.md5(F.concat_ws("|", F.lit(seed), F.col("id")))).withColumn("bucket", F.substring("key", 1, 3))
    sums = shuffled.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("bucket")
    sums = sums.select("rank", "bucket", (F.sum("words").over(before) - F.col("words")).alias("before"))
    within = Window.partitionBy("rank", "bucket").orderBy("key", "id", "size")
    placed = shuffled.withColumn("number", F.row_number().over(within))
    placed = placed.withColumn("offset", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return placed.join(sums, ["rank", "bucket"]).withColumn("begin", F.col("before") + F.col("offset")).drop("before", "offset", "key")


def block_length(total: int, most: int = BLOCK_WORDS) -> int:
    """Words of a block: a ``SLOTS``-th of the mix, at least one and at most ``most``."""
    return max(1, min(most, -(-total // SLOTS)))


def schedule(targets: DataFrame, total: int, block_words: int, step: float = GOLDEN) -> DataFrame:
    """``(slot, rank, block)``: the slots in order, each with its source and that source's next block.

    Slot ``n`` belongs to the source whose span of the cumulative targets holds the fractional part
    of ``n * step``. How many slots a source gets, and so what it takes, is up to the sequence alone.
    """
    spark = targets.sparkSession
    upto = F.sum("quota").over(Window.orderBy("rank"))
    spans = targets.select("rank", ((upto - F.col("quota")) / F.lit(float(max(1, total)))).alias("low"), (upto / F.lit(float(max(1, total)))).alias("high"), "quota").where("quota > 0")
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS)).cast("long")
    spans = spans.select("rank", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    point = F.col("slot") * F.lit(step)
    drawn = spark.range(-(-total // block_words)).withColumnRenamed("id", "slot").withColumn("point", point - F.floor(point)).withColumn("cell", cell(F.col("point")))
    drawn = drawn.join(spans, "cell").where("point >= low and point < high").select("slot", "rank", F.floor(F.col("slot") / CHUNK_SLOTS).alias("chunk"))
    before = Window.partitionBy("rank").orderBy("chunk")
    counts = drawn.groupBy("rank", "chunk").agg(F.count(F.lit(1)).alias("n")).select("rank", "chunk", (F.sum("n").over(before) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("slot"))
    return drawn.withColumn("place", place).join(counts, ["rank", "chunk"]).select("slot", "rank", (F.col("before") + F.col("place") - 1).alias("block"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), block_words: int = BLOCK_WORDS, seed: int = 7, step: float = GOLDEN) -> DataFrame:
    """The mix by document: ``(id, source, size, source_size, target, taken, n_slots, first_slot)``, a row for each input row.

    ``taken`` counts the words of the document in its source's first ``n_slots`` blocks, repeats
    included, and never over three times its size; ``first_slot`` is the slot of the block in which
    the document begins, null if it isn't taken. A source's taken words come within a few blocks of
    its target. Null and empty texts have size 0 and are never taken; null sources are one source,
    the last one; repeated rows are separate documents, and which of rows with one id and size
    comes first is of no effect on what they take together; an empty table gives an empty result.
    """
    docs = staged(df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    targets = staged(source_targets(docs, weights).coalesce(1), "targets")
    total = targets.agg(F.sum("quota")).first()[0] or 0
    words = block_length(total, block_words)
    slots = staged(schedule(targets, total, words, step), "slots")
    counts = staged(slots.groupBy("rank").agg(F.count(F.lit(1)).alias("n_slots")), "counts")
    got = F.coalesce("n_slots", F.lit(0).cast("long"))
    targets = staged(targets.join(counts, "rank", "left").withColumn("n_slots", got).withColumn("quota", F.least(F.col("source_size") * MAX_EPOCHS, F.col("n_slots") * words)).coalesce(1), "targets")
    line = word_line(docs, targets, seed)
    start = lambda e: F.col("begin") + e * F.col("source_size")
    part = lambda e: F.greatest(F.lit(0), F.least(start(e) + F.col("size"), F.col("quota")) - start(e))
    taken = line.withColumn("taken", sum(part(e) for e in range(1, MAX_EPOCHS)) + part(0))
    block = F.when(F.col("taken") > 0, F.floor(F.col("begin") / words))
    taken = taken.withColumn("block", block).join(slots, ["rank", "block"], "left")
    return taken.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "n_slots", F.col("slot").alias("first_slot"))
