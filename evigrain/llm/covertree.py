"""Embedding near-duplicates by dual traversal of cover trees.

The top of the tree is a farthest-first traversal of a bounded sample: its prefixes are nested nets
whose radii halve from level to level. Every vector goes to the cell of its nearest centre, and the
cells' covering radii are measured over all vectors. Two cells meet only if their centres are no
farther apart than both radii and the link distance, a vector visits another cell only within that
cell's radius and the link distance, and cells are cut into blocks of bounded size, so a task holds
two blocks whatever the skew. Within a task each block has nested nets of its own, and pairs of
nodes are pruned, accepted whole, or descended into by the same bounds, down to exact cosines.

Equal vectors are one row with a count from the start. Tasks return link counts and only such edges
as hold components together, so a group of copies or near copies gives rows in proportion to its size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrain.llm.groups import Forest
from evigrain.llm.staging import connected_components, staged

SAMPLE_ROWS = 1024
MAX_CELLS = 256
BLOCK_ROWS = 512, 16384
LEAF_ROWS = 64
SAFE = 1e-9


def unit(raw: list[bytes] | pd.Series, dtype: str, dim: int) -> np.ndarray:
    """Vectors scaled to length 1 in double precision; shorter ones are filled up with zeros."""
    out = np.zeros((len(raw), dim))
    for i, x in enumerate(raw):
        v = np.frombuffer(x, dtype).astype(np.float64)
        v = v / np.abs(v).max()
        out[i, : len(v)] = v / np.sqrt(v @ v)
    return out


def _usable(values: list | None) -> bool:
    if not values or any(v is None for v in values):
        return False
    return bool(np.isfinite(values).all() and np.any(values))


def keyed(df: DataFrame, id_col: str, vector_col: str, dtype: str) -> DataFrame:
    """``(id, key, raw)``; key and raw are null for vectors that link with nothing."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            raw = [(np.array(v, np.float64) + 0.0).astype(dtype).tobytes() if i is not None and _usable(v) else None for i, v in rows]
            keys = [x and hashlib.md5(x).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["id", "key", "raw"])

    return df.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(of, "id long, key binary, raw binary")


def farthest_first(points: np.ndarray, most: int) -> list[int]:
    """Places of the traversal's first points; it ends early when nothing is left apart."""
    chosen, far = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return chosen


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class Node:
    """A centre, its members, its covering radius over them, and the nodes of the next net."""

    def __init__(self, points: np.ndarray, centre: int, members: np.ndarray, radius: float):
        self.centre, self.members, self.children = centre, members, []
        self.cover = float(_distances(points[members], points[centre : centre + 1]).max()) if len(members) > 1 else 0.0
        if len(members) > LEAF_ROWS and self.cover > SAFE and radius > SAFE:
            self.children = net(points, members, radius / 2)


def net(points: np.ndarray, members: np.ndarray, radius: float) -> list[Node]:
    """Nodes whose centres are more than ``radius`` apart and cover all members within it."""
    nodes, left = [], members
    while len(left):
        some, centres = left[:256], []
        close = _distances(points[some], points[some]) <= radius
        free = np.ones(len(some), bool)
        for i in range(len(some)):
            if free[i]:
                centres.append(i)
                free &= ~close[i]
        far = _distances(points[left], points[some[centres]])
        nearest = far.argmin(axis=1)
        within = far[np.arange(len(left)), nearest] <= radius
        within[centres] = True
        nearest[centres] = np.arange(len(centres))
        order = np.argsort(nearest[within], kind="stable")
        groups = np.split(left[within][order], np.cumsum(np.bincount(nearest[within], minlength=len(centres)))[:-1])
        nodes += [Node(points, int(some[c]), g, radius) for c, g in zip(centres, groups, strict=True)]
        left = left[~within]
    return nodes


class Traversal:
    """Links between the nodes of two blocks, over shared arrays of points and counts."""

    def __init__(self, points: np.ndarray, counts: np.ndarray, least: float):
        self.points, self.counts, self.least = points, counts, least
        self.reach = math.sqrt(2.0 - 2.0 * least)
        self.links, self.forest = np.zeros(len(points), np.int64), Forest(len(points))

    def blocks(self, a: list[Node], b: list[Node], same: bool) -> None:
        """All node pairs within their covering radii and the link distance, a stripe at a time."""
        cover_b = np.array([n.cover for n in b])
        centres_b = self.points[[n.centre for n in b]]
        for at in range(0, len(a), 512):
            stripe = a[at : at + 512]
            far = _distances(self.points[[n.centre for n in stripe]], centres_b)
            near = far <= np.array([n.cover for n in stripe])[:, None] + cover_b + self.reach + SAFE
            for i, j in zip(*np.nonzero(near), strict=True):
                if not same or at + i <= j:
                    self.pair(stripe[i], b[j], float(far[i, j]), same and at + i == j)

    def pair(self, a: Node, b: Node, far: float, same: bool) -> None:
        if far + a.cover + b.cover < self.reach - SAFE:
            self.whole(a.members, b.members, same)
        elif len(a.members) * len(b.members) <= 1 << 16 or not (a.children or b.children):
            self.exact(a.members, b.members, same)
        elif same:
            self.blocks(a.children, a.children, True)
        else:
            self.blocks(a.children or [a], b.children or [b], False)

    def whole(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Every member links with every other one."""
        if same:
            self.links[a] += self.counts[a].sum() - self.counts[a]
        else:
            self.links[a] += self.counts[b].sum()
            self.links[b] += self.counts[a].sum()
        star = np.concatenate([a, b])
        self.forest.add(np.full(len(star), star[0]), star)

    def exact(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        for at in range(0, len(a), 1024):
            rows = a[at : at + 1024]
            linked = self.points[rows] @ self.points[b].T >= self.least
            if same:
                linked[np.arange(len(rows)), at + np.arange(len(rows))] = False
            i, j = np.nonzero(linked)
            if len(i):
                self.links[rows] += linked @ self.counts[b]
                if not same:
                    self.links[b] += self.counts[rows] @ linked
                self.forest.add(rows[i], b[j])


def link_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``, one row per input row.

    Vectors link at a cosine of ``least`` or more. Vectors that are null, empty, zero or hold null
    or non-finite components, and rows with a null id, link with nothing: no links, a component of
    their own id, kept. Shorter vectors are compared as if filled up with zeros; repeated rows
    link with each other; other columns aren't read; an empty table gives an empty result.
    """
    kind = df.schema[vector_col].dataType
    dtype = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
    rows = staged(keyed(df, id_col, vector_col, dtype), "vectors")
    copies = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("raw").alias("raw"))
    copies = staged(copies, "copies")
    shape = copies.agg(F.count(F.lit(1)), F.max(F.length("raw"))).first()
    total, dim = shape[0], (shape[1] or 0) // np.dtype(dtype).itemsize
    if not total:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    cap = min(BLOCK_ROWS[1], max(BLOCK_ROWS[0], -(-total // 12)))
    sample = unit([r[0] for r in copies.orderBy(F.xxhash64("key"), "key").select("raw").limit(SAMPLE_ROWS).collect()], dtype, dim)
    centres = sample[farthest_first(sample, min(MAX_CELLS, max(1, -(-total // (2 * cap)))))]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _distances(unit(batch.column(0).to_pylist(), dtype, dim), centres)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], names=["cell", "far"])

    measured = copies.select("raw").mapInArrow(placed, "cell int, far double").groupBy("cell").agg(F.max("far"), F.count(F.lit(1))).collect()
    cover, size = np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64)
    for cell, far, n in measured:
        cover[cell], size[cell] = far, n
    blocks = -(-size // cap)
    first = np.cumsum(blocks) - blocks
    every = int(blocks.sum())
    reach = math.sqrt(2.0 - 2.0 * least) + SAFE
    meet = _distances(centres, centres) <= cover[:, None] + cover[None, :] + reach

    def to_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = unit(batch.column("raw").to_pylist(), dtype, dim)
            far = _distances(points, centres)
            cell = far.argmin(axis=1)
            mixed = np.array([int.from_bytes(k[:8], "little") for k in batch.column("key").to_pylist()], np.uint64)
            own = first[cell] + (mixed % blocks[cell].astype(np.uint64)).astype(np.int64)
            for other in range(len(centres)):
                visit = np.flatnonzero(meet[cell, other] & (far[:, other] <= cover[other] + reach))
                for block in range(first[other], first[other] + blocks[other]):
                    if len(visit):
                        task = np.minimum(own[visit], block) * every + np.maximum(own[visit], block)
                        part = batch.take(pa.array(visit))
                        yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(own[visit] <= block), *part.columns], names=["task", "low", *part.schema.names])

    def in_task(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        points = unit(found["raw"], dtype, dim)
        run = Traversal(points, found["copies"].to_numpy(np.int64), least)
        low = found["low"].to_numpy(bool)
        same = key[0] // every == key[0] % every
        sides = [net(points, rows, run.reach) for rows in ((np.arange(len(points)),) if same else (np.flatnonzero(low), np.flatnonzero(~low)))]
        run.blocks(sides[0], sides[-1], same)
        linked, (a, b), rep = np.flatnonzero(run.links), run.forest.edges(), found["rep"].to_numpy(np.int64)
        counts = pd.DataFrame({"key": found["key"].to_numpy()[linked], "links": run.links[linked], "a": 0, "b": 0})
        edges = pd.DataFrame({"key": None, "links": 0, "a": rep[a], "b": rep[b]})
        return pd.concat([counts, edges]) if len(counts) else edges

    tasks = copies.select("key", "rep", "copies", "raw").mapInArrow(to_tasks, "task long, low boolean, key binary, rep long, copies long, raw binary")
    found = staged(tasks.groupBy("task").applyInPandas(in_task, "key binary, links long, a long, b long"), "links")
    links = found.where("key is not null").groupBy("key").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("key is null"), "a", "b").withColumnRenamed("node", "rep")
    groups = copies.select("key", "rep", "copies").join(links, "key", "left").join(roots, "rep", "left")
    groups = groups.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    result = rows.select("id", "key").join(groups, "key", "left")
    component = F.coalesce("component_id", "id")
    return result.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
