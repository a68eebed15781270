"""Candidates of a similarity join: bitmaps of sets, compared within blocks of sets of like sizes.

A bitmap holds, for each of its bits, whether an odd number of a set's tokens fall there. Two
bitmaps differ in no more bits than their sets have tokens that the other lacks, so pairs that
differ in more than similar sets could are left, and no similar pair is. Bitmaps are some bits a
token, powers of two in length; a longer one is folded to the length of a shorter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigrain.sources.staging import written

#: Bits in a bitmap, as powers of two.
BITS = 6, 15
#: Bytes of bitmaps in a block: as many as give some 64 blocks, within these bounds.
BLOCK_BYTES = 1 << 20, 1 << 24
BLOCKS = 64
#: Bitmaps that are compared at a time, and rows of pairs that leave a task together.
ROWS, COLUMNS, BATCH = 16, 4096, 1 << 16


def _share(least: float) -> float:
    """Of the sizes of two similar sets, added up, the part that may differ at most."""
    return (1 - least) / (1 + least)


def _marked(least: float) -> Callable:
    """Rows ``(..., tokens)``, tokens by their last bits, with size and bitmap in place of the tokens."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            n = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            wide = np.clip(np.ceil(np.log2(np.maximum(8 * _share(least) * n, 1))), *BITS).astype(np.int64)
            flat = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends, bits = np.cumsum(n), 1 << wide
            parts, start = [], 0
            while start < len(n):
                stop = start + max(1, int(np.searchsorted(np.cumsum(bits[start:]), 1 << 22, "right")))
                base = np.repeat(np.cumsum(bits[start:stop]) - bits[start:stop], n[start:stop])
                inside = flat[ends[start] - n[start] : ends[stop - 1]] & np.repeat(bits[start:stop] - 1, n[start:stop])
                odd = np.bincount(base + inside, minlength=int(bits[start:stop].sum())) & 1
                parts.append(np.packbits(odd.astype(np.uint8), bitorder="little"))
                start = stop
            offsets = np.concatenate([[0], np.cumsum(bits // 8)]).astype(np.int32)
            maps = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.concatenate([np.zeros(0, np.uint8), *parts]).tobytes())])
            others = [c for c in batch.schema.names if c != "tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(n, pa.int32()), maps], [*others, "n", "bits"])

    return marked


def _groups(table: pa.Table) -> dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(block, listed, bytes)`` to the ids, sizes and bitmaps of its sets, smallest first; bitmaps stand in columns."""
    number = lambda c: table.column(c).to_numpy()
    bits = table.column("bits").combine_chunks()
    keys, found = list(zip(number("no").tolist(), number("listed").tolist(), pc.binary_length(bits).to_pylist(), strict=True)), {}
    rows: dict[tuple, list[int]] = {}
    for i, key in enumerate(keys):
        rows.setdefault(key, []).append(i)
    for key, at in rows.items():
        order = np.array(at)[np.argsort(number("n")[at], kind="stable")]
        maps = np.frombuffer(b"".join(bits.take(pa.array(order)).to_pylist()), np.uint64).reshape(len(order), key[2] // 8)
        found[key] = number("ident")[order], number("n")[order], np.ascontiguousarray(maps.T)
    return found


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(maps.reshape(len(maps) // words, words, maps.shape[1]), axis=0)


def _near(a: tuple, b: tuple, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of the pairs of two groups, or of one with itself, whose sizes and bitmaps allow a similarity of ``least``."""
    (a_id, a_n, a_maps), (b_id, b_n, b_maps) = a, b
    words, share = min(len(a_maps), len(b_maps)), np.float32(_share(least))
    a_maps, b_maps = _folded(a_maps, words), _folded(b_maps, words)
    for i in range(0, len(a_n), ROWS):
        j = min(i + ROWS, len(a_n))
        first, last = (int(np.searchsorted(b_n, x, side)) for x, side in ((a_n[i] * least - 1e-6, "left"), (a_n[j - 1] / least + 1e-6, "right")))
        for k in range(max(first, i + 1) if same else first, last, COLUMNS):
            m = min(k + COLUMNS, last)
            differ = np.zeros((j - i, m - k), np.uint16)
            for w in range(words):
                differ += np.bitwise_count(a_maps[w, i:j, None] ^ b_maps[w, None, k:m])
            x, y = np.nonzero(differ <= (share * a_n[i:j] + np.float32(0.01)).astype(np.float32)[:, None] + (share * b_n[k:m]).astype(np.float32)[None, :])
            x, y = x + i, y + k
            fits = (a_n[x] >= least * b_n[y] - 1e-6) & (b_n[y] >= least * a_n[x] - 1e-6)
            fits &= (y > x) if same else True
            if fits.any():
                yield a_id[x[fits]], b_id[y[fits]]


def _met(least: float, apart: bool) -> Callable:
    """Pairs of the sets of two blocks, or of one, that may be similar; with ``apart`` only those of a listed set and one that isn't."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _groups(pa.Table.from_batches(list(batches)))
        blocks = sorted({key[0] for key in groups})
        held, size = [], 0
        for p in groups:
            for q in groups:
                if (p[0] != q[0] if len(blocks) > 1 else True) and p <= q and (not apart or p[1] != q[1]):
                    for a, b in _near(groups[p], groups[q], p == q, least):
                        held.append((np.minimum(a, b), np.maximum(a, b)))
                        size += len(a)
                        if size >= BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*held, strict=True)], ["left_id", "right_id"])
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*held, strict=True)], ["left_id", "right_id"])

    return met


def candidates(sets: DataFrame, cell: list[str], least: float, listed: DataFrame | None = None) -> DataFrame:
    """``(left_id, right_id)``: pairs of a cell's sets ``(ident, *cell, set)`` that hold all those with a Jaccard of ``least`` or more.

    With ``listed``, ids in its first column, only pairs of a listed set and one that isn't. Sets of
    a cell stand in blocks by size, and a block meets those whose sizes are within the threshold;
    bitmaps alone are sent, some bits a token, so what travels is small beside the sets.
    """
    near = lambda t: F.xxhash64(t).bitwiseAND(F.lit((1 << BITS[1]) - 1)).cast("short")
    rows = sets.select(F.col("ident").cast("long").alias("ident"), F.xxhash64(*cell).alias("area"), F.transform("set", near).alias("tokens"))
    maps = written(rows.mapInArrow(_marked(least), "ident long, area long, n int, bits binary"), "bitmaps").where("n > 0")
    weight = F.length("bits").cast("long")
    sizes = maps.groupBy("area", "n").agg(F.count(F.lit(1)).alias("held"), F.sum(weight).alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    unit = min(max(total // BLOCKS, BLOCK_BYTES[0]), BLOCK_BYTES[1])
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("area").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.pmod(F.xxhash64("ident"), "held") / F.col("held") * F.col("bytes")
    placed = maps.join(sizes.withColumn("before", before), ["area", "n"])
    placed = placed.select("area", F.floor((F.col("before") + within) / unit).alias("no"), "ident", "n", "bits", F.lit(False).alias("listed"))
    if listed is not None:
        marks = listed.select(F.col(listed.columns[0]).alias("its")).distinct()
        placed = placed.join(marks, F.col("ident") == F.col("its"), "left").withColumn("listed", F.col("its").isNotNull()).drop("its")
    placed = written(placed, "placed")
    spans = placed.groupBy("area", "no").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    a, b = spans.alias("a"), spans.alias("b")
    pairs = a.join(b, (F.col("a.area") == F.col("b.area")) & (F.col("a.no") <= F.col("b.no")) & (F.col("b.low") * least <= F.col("a.high") + 1e-6))
    both = F.explode(F.array_distinct(F.array("a.no", "b.no"))).alias("no")
    tasks = written(pairs.select("a.area", F.xxhash64("a.area", "a.no", "b.no").alias("task"), both), "block_pairs")
    parts = min(2 * max(1, tasks.count()), 2048)
    dealt = placed.join(tasks, ["area", "no"]).select("task", "no", "ident", "n", "bits", "listed").repartition(parts, "task")
    return dealt.groupBy("task").applyInArrow(_met(least, listed is not None), "left_id long, right_id long")
