"""SimHash near-duplicate detection over vantage-point trees.

A fingerprint pair within ``k`` bits agrees within ``k // 2`` bits in its low or in its high
32-bit half, so for small ``k`` there is one vantage-point tree for each half, and else one for the
whole fingerprint. A tree's nodes part the values by their Hamming distance from a vantage point,
and by the triangle inequality a fingerprint whose distance is within the radius of a node's
boundary is sent to both sides. Each leaf is a shard: it holds its home fingerprints and those
visitors from over the boundary whose own leaf comes later, so each pair meets once. Within a shard
the same tree is carried on until few are left, and those are compared over all 64 bits. The result
is exact.

The top of each tree is fitted on a sample of at most ``SAMPLE_PER_LEAF`` fingerprints a leaf; every
distinct fingerprint is routed through it. Equal fingerprints are one row from the start. Only edges
that hold a shard's components together leave it, so a group of copies gives rows in proportion to
its size.

A similarity of 0.8 is some ten bits. So wide a radius leaves trees over 64 bits nothing to prune,
since unrelated texts are 32 bits apart give or take four: such a search compares all pairs, spread
over the shards. It also takes a second fingerprint, of other bits of the hashes, that has to be as
close, since ten of 64 bits alone would link unrelated texts of a large corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.llm.groups import Forest
from evigrain.llm.staging import connected_components, staged

SEED = 42
SHARD_ROWS = 4096
SAMPLE_PER_LEAF = 32
HALVES_UP_TO = 7


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, repeats included; A-Z are lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - width + 1)


def other_bits(hashes: np.ndarray) -> np.ndarray:
    """A second hash of each hash (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (hashes ^ hashes >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; none: 0."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        bits = np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(id, fp, second)`` of every row: the fingerprint and the one of other bits, as signed longs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t.as_py(), width) for t in batch.column(1)]
            fps, seconds = [fingerprint(h) for h in hashes], [fingerprint(other_bits(h)) for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(seconds, pa.int64())], names=["id", "fp", "second"])

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(of, "id long, fp long, second long")


def _split(values: np.ndarray) -> tuple[int, int] | None:
    """A vantage point and the distance that parts ``values`` most evenly; None if none parts them."""
    best = None
    for at in np.linspace(0, len(values) - 1, min(6, len(values))).astype(int):
        far = np.bitwise_count(values ^ values[at])
        below = np.cumsum(np.bincount(far, minlength=65))[:-1]
        near = np.minimum(below, len(values) - below)
        cut = int(near.argmax())
        if near[cut] and (best is None or near[cut] > best[0]):
            best = (int(near[cut]), int(values[at]), cut)
    return best and best[1:]


def fit_tree(sample: np.ndarray, depth: int) -> list:
    """Nested ``[vantage, cut, inside, outside]``; a leaf is ``[]``."""
    found = _split(sample) if depth and len(sample) > 1 else None
    if not found:
        return []
    point, cut = found
    inside = np.bitwise_count(sample ^ sample.dtype.type(point)) <= cut
    return [point, cut, fit_tree(sample[inside], depth - 1), fit_tree(sample[~inside], depth - 1)]


def route(tree: list, values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf: its number, the rows that reach it, and whether each is at home there; visitors come from later leaves only."""
    leaves = iter(range(1 << 30))
    early = np.zeros(len(values), bool)  # rows that have been at home in an earlier leaf

    def walk(node: list, rows: np.ndarray, home: np.ndarray) -> Iterator:
        late = ~early[rows]
        rows, home = rows[late], home[late]
        if not node:
            leaf = next(leaves)
            early[rows[home]] = True
            if len(rows):
                yield leaf, rows, home
            return
        far = np.bitwise_count(values[rows] ^ values.dtype.type(node[0])).astype(np.int16)
        for side, reach, own in ((node[2], far <= node[1] + radius, far <= node[1]), (node[3], far > node[1] - radius, far > node[1])):
            yield from walk(side, rows[reach], home[reach] & own[reach])

    yield from walk(tree, np.arange(len(values)), np.ones(len(values), bool))


class Shard:
    """The search among the fingerprints of one leaf."""

    def __init__(self, fps: np.ndarray, seconds: np.ndarray | None, values: np.ndarray, radius: int, most: int):
        self.fps, self.seconds, self.values, self.radius, self.most, self.out = fps, seconds, values, radius, most, Forest(len(fps))

    def search(self, home: np.ndarray, visit: np.ndarray) -> None:
        """Home rows against visiting rows (home ones included), by the same tree until few are left."""
        found = _split(self.values[home]) if len(home) > 48 else None
        if not found:
            self.compare(home, visit)
            return
        point, cut = self.values.dtype.type(found[0]), found[1]
        own = np.bitwise_count(self.values[home] ^ point).astype(np.int16)
        far = np.bitwise_count(self.values[visit] ^ point).astype(np.int16)
        self.search(home[own <= cut], visit[far <= cut + self.radius])
        self.search(home[own > cut], visit[far > cut - self.radius])

    def compare(self, home: np.ndarray, visit: np.ndarray) -> None:
        step = max(1, (1 << 17) // max(1, len(home)))
        for i in range(0, len(visit), step):
            a, b = np.nonzero(np.bitwise_count(self.fps[visit[i : i + step], None] ^ self.fps[None, home]) <= self.most)
            a, b = visit[i : i + step][a], home[b]
            keep = a != b
            if self.seconds is not None:
                keep &= np.bitwise_count(self.seconds[a] ^ self.seconds[b]) <= self.most
            self.out.add(a[keep], b[keep])


def _part(fps: np.ndarray, side: int | None) -> np.ndarray:
    return fps if side is None else (fps >> np.uint64(32 * side)).astype(np.uint32)


def linked_fingerprints(distinct: DataFrame, max_distance: int, shard_rows: int = SHARD_ROWS, max_depth: int = 12) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct fingerprints ``fp`` just as all pairs within ``max_distance`` do."""
    sides, radius = ((0, 1), max_distance // 2) if max_distance <= HALVES_UP_TO else ((None,), max_distance)
    confirm = max_distance > HALVES_UP_TO
    depth = min(max_depth, max(6, math.ceil(math.log2(max(1, distinct.count() / shard_rows)))))
    sample_limit = SAMPLE_PER_LEAF << depth
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(sample_limit).collect()], np.int64).view(np.uint64)
    trees = [fit_tree(_part(sample, side), depth) for side in sides]

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, seconds = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for k, side in enumerate(sides):
                for leaf, rows, home in route(trees[k], _part(fps.view(np.uint64), side), radius):
                    columns = [pa.array(np.full(len(rows), len(sides) * leaf + k, np.int32)), pa.array(fps[rows])]
                    columns += [pa.array(seconds[rows])] * confirm + [pa.array(home)]
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "fp", *["second"] * confirm, "home"])

    def in_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
        seconds = rows["second"].to_numpy(np.int64).view(np.uint64) if confirm else None
        shard = Shard(fps, seconds, _part(fps, sides[int(key[0]) % len(sides)]), radius, max_distance)
        home = np.flatnonzero(rows["home"].to_numpy(bool))
        if len(home):
            shard.search(home, np.arange(len(fps)))
        a, b = shard.out.edges()
        signed = fps.view(np.int64)
        return pd.DataFrame({"a": signed[a], "b": signed[b]})

    schema = "shard int, fp long, " + "second long, " * confirm + "home boolean"
    return distinct.select("fp", "second").mapInArrow(to_shards, schema).groupBy("shard").applyInPandas(in_shard, "a long, b long")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_distance: int = 3) -> DataFrame:
    """Near-duplicate groups: ``(id_col, fp, fingerprint, component_id)``, one row per input row.

    Fingerprints link at ``max_distance`` or fewer differing bits, for more than ``HALVES_UP_TO``
    only if the second fingerprints do so too; ``component_id`` is the smallest
    id reachable by links. Null and empty texts have fingerprint zero and link like any other;
    repeated rows stay repeated; a null id never becomes a component's id unless all of its ids are
    null; an empty table gives an empty result. Other columns of ``df`` aren't read.
    """
    fps = staged(fingerprints(df, id_col, text_col, width), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("id").alias("first_id"), F.min("second").alias("second")), "distinct")
    roots = connected_components(linked_fingerprints(distinct, max_distance), "a", "b")
    rooted = staged(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    lowest = staged(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    groups = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(groups, "fp").select(F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
