"""Vectorised helpers for components inside one task."""

from __future__ import annotations

import numpy as np


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the smallest node of each node's component."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        keep = low != high
        if not keep.any():
            return root
        a, b, low, high = a[keep], b[keep], low[keep], high[keep]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


class Forest:
    """Gathers edges and keeps only as many as hold the components together."""

    def __init__(self, n: int, most: int = 1 << 20):
        self.n, self.most, self.root, self.waiting, self.count = n, most, np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.waiting.append((a, b))
            self.count += len(a)
            if self.count > self.most:
                self._fold()

    def _fold(self) -> None:
        a = np.concatenate([np.arange(self.n), *(x for x, _ in self.waiting)])
        b = np.concatenate([self.root, *(x for _, x in self.waiting)])
        self.root, self.waiting, self.count = local_roots(self.n, a, b), [], 0

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, root) of every node that isn't the root itself."""
        self._fold()
        node = np.flatnonzero(self.root != np.arange(self.n))
        return node, self.root[node]
