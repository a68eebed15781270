"""Packed, sorted runs: 64-bit keys with 32-bit values, as one compressed row for each shard."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys with 32-bit values, compressed."""
    n = len(keys)
    planes = [np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(n, 8).T.tobytes()]
    planes += [v.astype(np.uint32).view(np.uint8).reshape(n, 4).T.tobytes() for v in values]
    return struct.pack("<I", n) + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpack(blob: bytes, values: int) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", blob)
    raw = np.frombuffer(pa.decompress(blob[4:], decompressed_size=n * (8 + 4 * values), codec="zstd", asbytes=True), np.uint8)
    keys = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
    return [keys] + [np.ascontiguousarray(raw[(8 + 4 * i) * n : (12 + 4 * i) * n].reshape(4, n).T).view(np.uint32).ravel() for i in range(values)]


def split_runs(keys: np.ndarray, shards: np.ndarray, values: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """A packed run for each shard; ``keys`` are sorted."""
    order = np.argsort(shards, kind="stable")
    cuts = np.flatnonzero(np.diff(shards[order])) + 1
    for rows in np.split(order, cuts) if len(order) else ():
        yield int(shards[rows[0]]), pack(keys[rows], *(v[rows] for v in values))
