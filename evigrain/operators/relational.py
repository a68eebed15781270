"""Operators that the engine's queries share: ranking, fusion, votes, latest rows, intervals, set similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.operators import likeness
from evigrain.sources.staging import written


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, by, order, 1).drop("rank")


def fused(left: DataFrame, right: DataFrame, by: list[str], item: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists ``(*by, item, rank)``."""
    joined = left.withColumnRenamed("rank", "l").join(right.withColumnRenamed("rank", "r"), [*by, item], "full_outer")
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    return joined.select(*by, item, F.col("l").alias("left_rank"), F.col("r").alias("right_rank"), (part("l") + part("r")).alias("score"))


def majority(votes: DataFrame, by: list[str], choice: str) -> DataFrame:
    """Winner by votes, then name; its share of all votes; whether it has a strict majority."""
    counts = votes.groupBy(*by, choice).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col(choice).alias("choice")))
    found = counts.groupBy(*by).agg(best.alias("best"), F.sum("n").alias("votes"))
    top = -F.col("best.minus")
    return found.select(*by, F.col("best.choice").alias("winner"), top.alias("winner_votes"), "votes", (top / F.col("votes")).alias("share"), (top >= F.floor(F.col("votes") / 2) + 1).alias("passed"))


def modal_samples(samples: DataFrame, by: list[str], choice: str, order: str) -> DataFrame:
    """The first sample, by ``order``, of the choice with most votes; among equals the choice that was made first. With ``winner_votes`` and ``votes``.

    Samples without a choice don't vote. Each choice is reduced to its count and first sample before
    choices meet, so a group's samples are never in one place.
    """
    first = F.min_by(F.struct(*samples.columns), order).alias("sample")
    counts = samples.where(F.col(choice).isNotNull()).groupBy(*by, choice).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("made"), first)
    best = F.min_by(F.struct("sample", "n"), F.struct((-F.col("n")).alias("minus"), "made")).alias("best")
    found = counts.groupBy(*by).agg(best, F.sum("n").alias("votes"))
    return found.select("best.sample.*", F.col("best.n").alias("winner_votes"), "votes")


def panel_verdicts(votes: DataFrame, by: str, lens: str, refuted: str) -> DataFrame:
    """``(by, lenses, refuted, refuted_by, survives, score)``: a claim survives unless a majority of its lenses refutes it; null votes don't refute."""
    against = F.coalesce(F.col(refuted), F.lit(False))
    found = votes.groupBy(by).agg(F.count(F.lit(1)).alias("lenses"), F.count_if(against).alias("refuted"), F.array_join(F.array_sort(F.collect_list(F.when(against, F.col(lens)))), ",").alias("refuted_by"))
    return found.withColumns({"survives": F.col("refuted") < F.floor(F.col("lenses") / 2) + 1, "score": (F.col("lenses") - F.col("refuted")) / F.col("lenses")})


def merged_intervals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching intervals in each group; empty ones are dropped."""
    order = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    numbered = df.where(F.col(end) > F.col(start)).withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order))
    return numbered.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")).drop("_island")


def ranked(df: DataFrame, by: list[str], order: str, name: str = "rank", width: int = 1 << 16) -> DataFrame:
    """``df`` with each row's place in its group, from 1, by an integer column that differs within the group.

    Places within slices of ``width`` values, and the sum of the slices before: no task holds a whole
    group, however large one is. A null group is a group like any other.
    """
    slice_ = F.floor(F.col(order) / width).alias("_slice")
    rows = df.withColumn("_slice", slice_)
    counts = rows.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate([*by, "_slice"])), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(order))
    same = F.lit(True)
    for i, c in enumerate([*by, "_slice"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    return rows.withColumn("_inside", inside).join(offsets, same).select(*(F.col(c) for c in df.columns), (F.col("_inside") + F.col("_before")).alias(name))


#: Rows of ids that may be sent to every task.
SMALL = 1 << 20


def _sent(df: DataFrame) -> DataFrame:
    """A written table of ids, marked to be sent to every task if it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def set_classes(df: DataFrame, ident: str, cell: list[str], tokens: str | Column) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``(ident, *cell, class_id)``: the smallest id with an equal set in the cell; and a function that makes the sets.

    The function gives ``(ident, *cell, set, class_id)`` of all rows, or of those in a table of ids
    ``ident``; only these rows' tokens are then taken. Digests alone are compared and written. Rows
    without tokens have no class, and an empty set.
    """
    set_, row = F.array_distinct(tokens), F.xxhash64(*df.columns)
    digest = F.unhex(F.sha2(F.concat_ws(chr(0), F.array_sort(set_)), 256)).alias("_digest")
    rows = written(df.select(F.col(ident).alias("ident"), *cell, row.alias("_row"), digest, F.size(set_).alias("_n")), "digests").where("_n > 0")
    first = rows.groupBy(*(F.col(c).alias(f"_{c}") for c in cell), F.col("_digest").alias("_its_digest")).agg(F.min("ident").alias("class_id"))
    same = F.col("_digest") == F.col("_its_digest")
    for c in cell:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    members = written(rows.join(first, same).select("ident", *cell, "class_id", "_row"), "classes")
    copies = written(members.where("ident <> class_id").select(F.col("ident").alias("_copy"), F.col("_row").alias("_its"), "class_id").distinct(), "copies")

    def made(ids: DataFrame | None = None) -> DataFrame:
        known = df if ids is None else df.join(_sent(ids.select(F.col("ident").alias("_wanted"))), F.col(ident) == F.col("_wanted"), "left_semi")
        known = known.join(_sent(copies), (F.col(ident) == F.col("_copy")) & (row == F.col("_its")), "left")
        return known.select(F.col(ident).alias("ident"), *cell, F.coalesce(set_, F.array().cast("array<string>")).alias("set"), F.coalesce("class_id", ident).alias("class_id"))

    return members.drop("_row"), made


def token_sets(df: DataFrame, ident: str, cell: list[str], token_col: str) -> DataFrame:
    """``(ident, *cell, set, class_id)``: sets that aren't empty, and the smallest id with an equal set in the cell."""
    return set_classes(df, ident, cell, token_col)[1]().where("size(set) > 0")


def similar_pairs(sets: DataFrame | Callable[..., DataFrame], cell: list[str], least: float, width: int = 128, listed: DataFrame | None = None) -> DataFrame:
    """Pairs ``(*cell, left_id, right_id, similarity)`` of different sets of a cell with a Jaccard of ``least`` or more.

    ``sets`` are those of ``token_sets``, with integer ids, or the function of ``set_classes`` that
    makes them; only the first row of each class takes part, so copies don't meet in pairs. With
    ``listed``, ids in its first column, pairs of a listed set and one that isn't alone are looked
    for. Tokens are compared by 64-bit hashes.

    Pairs that may be similar are found by bitmaps (``likeness.candidates``), so sets that are like
    no other stay where they are. The others stand together with their kin, the smallest id that
    they may be similar to, in blocks of at most ``width``, and the smaller block's sets are sent to
    the larger: of a group of thousands of near copies a set travels once for each hundred others,
    not once for each pair. All pairs of two blocks that meet are compared.
    """
    made = sets if callable(sets) else lambda ids=None: sets if ids is None else sets.join(ids, "ident", "left_semi")
    pairs = written(likeness.candidates(made().where("ident = class_id"), cell, least, listed), "candidates")
    ends = pairs.select(F.col("left_id").alias("ident"), F.col("left_id").alias("other")).unionByName(pairs.select(F.col("right_id").alias("ident"), F.col("left_id").alias("other")))
    kin = ends.groupBy("ident").agg(F.min("other").alias("kin"))
    placed = ranked(kin, ["kin"], "ident", "place")
    blocks = written(placed.select("ident", "kin", F.floor((F.col("place") - 1) / width).alias("part")).select("ident", F.xxhash64("kin", "part").alias("block")), "blocks")
    side = lambda x: blocks.select(F.col("ident").alias(f"{x}_id"), F.col("block").alias(f"{x}_block"))
    met = pairs.join(side("left"), "left_id").join(side("right"), "right_id").select(F.least("left_block", "right_block").alias("small"), F.greatest("left_block", "right_block").alias("large")).distinct()
    standing = made(blocks.select("ident")).where("ident = class_id").join(_sent(blocks), "ident").select("block", "ident", *cell, F.array_distinct(F.transform("set", lambda t: F.xxhash64(t, *cell))).alias("set"))
    standing = written(standing.withColumn("n", F.size("set")), "standing")
    its = lambda x, block: standing.select(F.col("block").alias(block), *(F.col(c).alias(f"{x}_{c}") for c in ["ident", *cell, "n", "set"]))
    both = met.join(its("x", "small"), "small").join(its("y", "large"), "large")
    both = both.where(((F.col("small") != F.col("large")) | (F.col("x_ident") < F.col("y_ident"))) & (F.col("x_n") >= least * F.col("y_n")) & (F.col("y_n") >= least * F.col("x_n")))
    for c in cell:
        both = both.where(F.col(f"x_{c}").eqNullSafe(F.col(f"y_{c}")))
    common = F.size(F.array_intersect("x_set", "y_set"))
    both = both.select(*(F.col(f"x_{c}").alias(c) for c in cell), F.least("x_ident", "y_ident").alias("left_id"), F.greatest("x_ident", "y_ident").alias("right_id"), (common / (F.col("x_n") + F.col("y_n") - common)).alias("similarity"))
    return both.where(F.col("similarity") >= least)


def containing(texts: DataFrame, text_id: str, items: DataFrame, item_id: str) -> DataFrame:
    """Pairs ``(item_id, text_id)`` whose text holds the item's text verbatim.

    An item's longest inner word stands in every text that holds the item, as a word between
    spaces. Words and ids alone are joined on it; only the texts of the candidates that are left
    are then read for the test. Items without an inner word, of one or two words, are tested
    against all texts.
    """
    t, i = texts.select(F.col(text_id).alias("_t"), F.col("text").alias("_text")), items.select(F.col(item_id).alias("_i"), F.col("text").alias("_item"))
    words = F.split("_item", " ")
    inner = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.length(w) > 0)
    longest = F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    i = i.withColumn("_word", F.try_element_at(longest, F.lit(1))["w"])
    keyed = i.where("_word is not null")
    by_word = t.select("_t", F.explode(F.array_distinct(F.split("_text", " "))).alias("_word"))
    hit = F.contains("_text", "_item")
    candidates = keyed.select("_i", "_word").join(by_word, "_word").select("_i", "_t").distinct()
    found = candidates.join(keyed.select("_i", "_item"), "_i").join(t, "_t").where(hit).select("_i", "_t")
    rest = i.where("_word is null and length(_item) > 0").join(t, hit).select("_i", "_t")
    return found.unionByName(rest).select(F.col("_i").alias(item_id), F.col("_t").alias(text_id))


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """``(node, depth)``: first arrival from ``seeds`` (column ``node``) over ``edges (src, dst)``, at most ``max_depth`` steps."""
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(frontier)
    return seen


def precision_recall(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of every label, 0 where a denominator is."""
    roles = F.when(F.col(truth) == F.col(predicted), F.array(F.struct(F.col(truth).alias("label"), F.lit("tp").alias("role"))))
    roles = roles.otherwise(F.array(F.struct(F.col(truth).alias("label"), F.lit("fn").alias("role")), F.struct(F.col(predicted).alias("label"), F.lit("fp").alias("role"))))
    counts = df.select(F.explode(roles).alias("x")).groupBy("x.label").agg(*(F.count_if(F.col("x.role") == r).alias(r) for r in ("tp", "fp", "fn")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("label", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))
