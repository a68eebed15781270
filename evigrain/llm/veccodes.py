"""Vector code compression: a codebook for each part of the vectors, by Lloyd's method with filtering.

Vectors become integers, so every distance, sum and mean is exact and the result doesn't depend on
how rows are dealt to tasks. Each task cuts its rows into blocks of bounded size and builds a
kd-tree over each part of a block's vectors, whose nodes hold a box, a sum and a count. The trees
are staged once. In every round a node starts with the entries its parent left, drops those that
are farther than another one for each point of the box, and is assigned whole once one entry is
left. Only the sums of the entries leave a task.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.llm.staging import staged

SCALE = 4096
#: Integers beyond this are moved to it, so that no sum of squares overflows: components of 32,768 and more.
LARGEST = 1 << 27
BLOCK_ROWS, LEAF_ROWS = 4096, 16
#: Up to so many labels their sums are broadcast, 16 bytes and a label each; beyond, rows and sums are shuffled.
BROADCAST_LABELS = 100_000


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(id, label, v)``: vectors that are present and finite in all components, as ``floor(4096 * x)``."""
    values = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), values.alias("x"))
    rows = rows.where(F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    bounded = lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    return rows.select("id", "label", F.transform("x", bounded).alias("v"))


class Tree:
    """A kd-tree over the rows of ``points``, whose leaves are equal cuts of the rows in ``order``."""

    def __init__(self, points: np.ndarray, order: np.ndarray, leaves: int):
        self.points, self.order = points, order
        self.bounds = np.arange(leaves + 1) * len(points) // leaves
        low, high = (f.reduceat(points, self.bounds[:-1], axis=0) for f in (np.minimum, np.maximum))
        self.levels = [(low, high, np.add.reduceat(points, self.bounds[:-1], axis=0), np.diff(self.bounds))]
        while len(low) > 1:
            low, high, total, count = self.levels[0]
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.levels.insert(0, (low, high, total[::2] + total[1::2], count[::2] + count[1::2]))

    @classmethod
    def over(cls, rows: np.ndarray) -> Tree:
        """Each node is halved where its box is widest, until leaves have some 16 rows."""
        n, leaves, order = len(rows), 1, np.arange(len(rows))
        while n // (2 * leaves) >= LEAF_ROWS:
            bounds = np.arange(leaves + 1) * n // leaves
            low, high = (f.reduceat(rows[order], bounds[:-1], axis=0) for f in (np.minimum, np.maximum))
            node = np.repeat(np.arange(leaves), np.diff(bounds))
            order = order[np.lexsort((rows[order, (high - low).argmax(axis=1)[node]], node))]
            leaves *= 2
        return cls(rows[order], order, leaves)

    def pack(self) -> bytes:
        n, width = self.points.shape
        return struct.pack("<3I", n, width, len(self.bounds) - 1) + self.order.astype("<u4").tobytes() + self.points.astype("<i4").tobytes()

    @classmethod
    def unpack(cls, blob: bytes) -> Tree:
        n, width, leaves = struct.unpack_from("<3I", blob)
        points = np.frombuffer(blob, "<i4", n * width, 12 + 4 * n).reshape(n, width).astype(np.int64)
        return cls(points, np.frombuffer(blob, "<u4", n, 12).astype(np.int64), leaves)


def filtered(tree: Tree, book: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(level, nodes, entries)`` of subtrees that are assigned whole, and at last ``(-1, rows, entries)`` of single rows.

    Together these cover each row once, with its nearest entry, the first of equally near ones.
    """
    number = np.arange(len(book))
    squares = (book * book).sum(axis=1)
    nodes, able = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    for level, (low, high, _, _) in enumerate(tree.levels):
        a, b = low[nodes], high[nodes]
        middle = np.where(able, ((2 * book - (a + b)[:, None]) ** 2).sum(axis=2), np.iinfo(np.int64).max)
        best = middle.argmin(axis=1)
        away = book - book[best][:, None]
        corner = np.where(away > 0, b[:, None], a[:, None])
        margin = squares - squares[best][:, None] - 2 * (corner * away).sum(axis=2)
        able &= (margin < 0) | ((margin == 0) & (number <= best[:, None]))
        single = able.sum(axis=1) == 1
        if single.any():
            yield level, nodes[single], best[single]
        nodes, able = nodes[~single], able[~single]
        if not len(nodes):
            return
        if level + 1 < len(tree.levels):
            nodes, able = (2 * nodes[:, None] + np.arange(2)).ravel(), np.repeat(able, 2, axis=0)
    size = np.diff(tree.bounds)[nodes]
    rows = np.arange(size.sum()) + np.repeat(tree.bounds[nodes] - np.cumsum(size) + size, size)
    far = ((tree.points[rows][:, None] - book) ** 2).sum(axis=2)
    yield -1, rows, np.where(np.repeat(able, size, axis=0), far, np.iinfo(np.int64).max).argmin(axis=1)


def entry_sums(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the rows nearest to each entry."""
    total, count = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    for level, found, entries in filtered(tree, book):
        _, _, sums, counts = tree.levels[level] if level >= 0 else (None, None, tree.points, np.ones(len(tree.points), np.int64))
        np.add.at(total, entries, sums[found])
        np.add.at(count, entries, counts[found])
    return total, count


def assignments(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row, in the rows' first order."""
    sorted_entries = np.empty(len(tree.points), np.int64)
    for level, found, entries in filtered(tree, book):
        if level < 0:
            sorted_entries[found] = entries
        else:
            step = (len(tree.bounds) - 1) >> level
            for node, entry in zip(found.tolist(), entries.tolist(), strict=True):
                sorted_entries[tree.bounds[node * step] : tree.bounds[(node + 1) * step]] = entry
    entries, error = np.empty_like(sorted_entries), np.empty_like(sorted_entries)
    entries[tree.order] = sorted_entries
    error[tree.order] = ((tree.points - book[sorted_entries]) ** 2).sum(axis=1)
    return entries, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def encode_vectors(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id_col, code, error, label_error, codebooks_sha256)``: two hex digits of a code for each part of a vector.

    A codebook starts as the parts of the ``entries`` smallest ids (null ids last, repeated ids by
    vector), of all rows where there are fewer. Each round assigns all parts to the nearest entry,
    the first of equally near ones, and moves each entry that has parts to their mean, rounded
    down. ``error`` is the squared distance over all parts, ``label_error`` its sum over rows of an
    equal label, null labels together.

    Rows whose vector is null or holds null or non-finite components go; repeated rows stay, each
    with its code. Vectors are filled up with zeros to the longest one's length and that to a
    multiple of ``parts``; vectors without components have all codes 0. Components of an absolute
    value of 32,768 or more count as 32,768. An empty table gives an empty result. Other columns
    of ``df`` aren't read. Whatever leaves the tasks for the driver, ``entries`` vectors at first
    and as many sums in each round, doesn't grow with the rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits")
    label_type = df.schema[label_col].dataType.simpleString()
    rows = integer_vectors(df, id_col, vec_col, label_col)
    first = rows.orderBy(F.asc_nulls_last("id"), F.size("v"), "v").limit(entries).collect()
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    books = np.zeros((parts, len(first), width), np.int64)
    for i, row in enumerate(first):
        books[:, i] = np.pad(np.array(row["v"], np.int64), (0, parts * width - len(row["v"]))).reshape(parts, width)

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def block(rows: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks().to_batches()[0]
            points = _matrix(rows.column(2), parts * width)
            trees = [Tree.over(points[:, p * width : (p + 1) * width]).pack() for p in range(parts)]
            lists = [pa.ListArray.from_arrays([0, rows.num_rows], rows.column(i)) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            while sum(b.num_rows for b in waiting) >= BLOCK_ROWS:
                table = pa.Table.from_batches(waiting)
                yield block(table.slice(0, BLOCK_ROWS))
                waiting = table.slice(BLOCK_ROWS).to_batches()
        if waiting:
            yield block(pa.Table.from_batches(waiting))

    if not longest or not first:  # no components at all: every code is 0
        digest = hashlib.sha256(b"").hexdigest()
        return rows.select(F.col("id").alias(id_col), F.lit("00" * parts).alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
    blocks = staged(rows.mapInArrow(planted, f"ids array<long>, labels array<{label_type}>, trees array<binary>"), "trees")

    for _ in range(rounds):
        total, count = _sums(blocks, books)
        moved = count > 0
        books[moved] = np.floor_divide(total[moved], count[moved][:, None])

    final = books.copy()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = [assignments(Tree.unpack(blob), final[p]) for p, blob in enumerate(batch.column(2)[i].as_py())]
                codes = np.stack([entries for entries, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                error = sum(e for _, e in found)
                texts = [codes[at : at + 2 * parts] for at in range(0, len(codes), 2 * parts)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(texts, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    coded_rows = staged(blocks.mapInArrow(coded, f"id long, label {label_type}, code string, error long"), "codes")
    sums = staged(coded_rows.groupBy(F.col("label").alias("its_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    few = sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    met = coded_rows.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("its_label")))
    digest = hashlib.sha256(",".join(map(str, final.ravel().tolist())).encode()).hexdigest()
    return met.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sums(blocks: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts over all rows, for each part and entry; a task gives one row for each that has any."""
    shape, now = books.shape, books.copy()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for batch in batches:
            for trees in batch.column(0):
                for p, blob in enumerate(trees.as_py()):
                    sums, counts = entry_sums(Tree.unpack(blob), now[p])
                    total[p] += sums
                    count[p] += counts
        part, entry, at = (x.ravel() for x in np.indices(shape))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (part, entry, at, total.ravel(), count[part, entry])], names=["part", "entry", "at", "total", "n"])

    found = blocks.select("trees").mapInArrow(summed, "part long, entry long, at long, total long, n long")
    total, count = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
    for row in found.where("n > 0").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        total[row["part"], row["entry"], row["at"]] = row["total"]
        count[row["part"], row["entry"]] = row["n"]
    return total, count
