"""Near copies: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

SimHash over vantage-point trees names the candidates, and the shingle sets of each candidate pair
decide. Documents with the same set are one node from the start. A node has three independent 64-bit
fingerprints of its set (each shingle once). At a similarity of 0.8 a bit differs with a chance of
0.151, 29 of 192 bits give or take five: pairs over ``MOST_BITS`` aren't looked at further, which
costs one pair of 0.8 in a hundred thousand. The bits are twelve parts of 16, and sets meet where
they are within one bit in a part: two sets of similarity 0.8 are that close in one part with a
chance of 0.28, so twelve parts miss 2 % of pairs just at 0.8, 0.4 % at 0.85 and some 0.03 % at 0.9.
Unrelated sets are that close in a part once in 3,900 pairs. Parts within one bit have an equal half
of eight bits, so each half has a vantage-point tree with radius zero: a node reaches one leaf of
each of the 24 trees, however deep they are, and what is shuffled grows with the number of nodes. In
a leaf the search goes on by a tree over the whole part, with radius one. Leaves that many nodes
share are cut into blocks of bounded size, and pairs of blocks are tasks of their own.

Sets of fewer than six shingles may differ in more bits at 0.8; their bound is ``SMALL_BITS``. Sets
whose sizes alone rule out the similarity are no candidates.

Components need no more than a link for each of their nodes. A first search names for each node its
closest candidate in each task, and the nodes that have several in one task: only between two such
nodes is a pair left unnamed. The second search takes these nodes alone and looks at all candidates
that the first one's links have not joined, but a task names only as many as hold its candidates
together, fewer than it has nodes. What they connect are kin: every candidate pair is within one
kin. The nodes of a kin then meet with their shingle sets in pairs of blocks, where all pairs that
the fingerprints allow are compared, and again only links that connect leave a task. So neither
search lists the pairs of a large group, linked or not, and none is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.llm.simhash import SAMPLE_PER_LEAF, Shard, fingerprint, fit_tree, other_bits, route, shingle_hashes
from evigrain.llm.staging import connected_components, sieved, staged

PART_BITS, HALF_BITS, RADIUS = 16, 8, 1
FIRST_BITS = 26
MOST_BITS = 51
SMALL, SMALL_BITS = 6, 66
LEAF_ROWS, BLOCK_ROWS = 8192, 32768
#: A kin has a block for each so many nodes, up to ``KIN_BLOCKS`` of them; more only where blocks would hold over ``KIN_HASHES`` shingles.
KIN_ROWS, KIN_BLOCKS, KIN_HASHES = 128, 24, 1 << 20
NODES = "id long, node long, fp long, second long, third long, n int"
PRINTS = "fp", "second", "third"


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    return np.unique(shingle_hashes(text, width))


def node_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def _nodes(df: DataFrame, width: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
            second = [other_bits(s) for s in sets]
            columns = [[node_of(s) for s in sets], *([fingerprint(x) for x in hashes] for hashes in (sets, second, map(other_bits, second)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array([len(s) for s in sets], pa.int32())], names=["id", "node", *PRINTS, "n"])

    return df.mapInArrow(of, NODES)


def _sets(df: DataFrame, width: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])

    return df.mapInArrow(of, "node long, hashes binary")


def allowed(far: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles that differ in ``far`` bits may have the similarity."""
    low, high = np.minimum(n, m), np.maximum(n, m)
    return (low >= similarity * high - 1e-9) & (far <= np.where(low < SMALL, SMALL_BITS, MOST_BITS))


class Candidates(Shard):
    """Candidate pairs among the nodes of one task whose roots differ: each node's closest one, all, or as many as connect what all do."""

    def __init__(self, prints: list[np.ndarray], part: np.ndarray, sizes: np.ndarray, roots: np.ndarray, similarity: float, closest: bool, spanning: bool):
        super().__init__(prints[0], None, part, RADIUS, FIRST_BITS)
        self.prints, self.sizes, self.roots, self.similarity, self.closest, self.spanning = prints, sizes, roots, similarity, closest, spanning
        self.best, self.met, self.pairs = np.full(len(part), 1 << 62), np.zeros(len(part), np.int64), []

    def compare(self, home: np.ndarray, visit: np.ndarray) -> None:
        step = max(1, (1 << 17) // max(1, len(home)))
        for i in range(0, len(visit), step):
            a, b = np.nonzero(np.bitwise_count(self.fps[visit[i : i + step], None] ^ self.fps[None, home]) <= FIRST_BITS)
            a, b = visit[i : i + step][a], home[b]
            keep = self.roots[a] != self.roots[b]
            a, b = a[keep], b[keep]
            far = sum(np.bitwise_count(p[a] ^ p[b]).astype(np.int64) for p in self.prints)
            keep = allowed(far, self.sizes[a], self.sizes[b], self.similarity)
            a, b, far = a[keep], b[keep], far[keep]
            if self.closest:
                np.minimum.at(self.best, a, far << 40 | b)
                np.minimum.at(self.best, b, far << 40 | a)
                self.met += np.bincount(a, minlength=len(self.met)) + np.bincount(b, minlength=len(self.met)) if len(a) else 0
            elif self.spanning:
                self.out.add(a, b)
            elif len(a):
                self.pairs.append((a, b))

    def found(self, times: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs; where only the closest are wanted, also ``(a, a)`` for each node that met more than one other, ``times`` times each."""
        if self.closest:
            a, crowded = np.flatnonzero(self.best < 1 << 62), np.flatnonzero(self.met > times)
            return np.concatenate([a, crowded]), np.concatenate([self.best[a] & ((1 << 40) - 1), crowded])
        if self.spanning:
            return self.out.edges()
        return tuple(np.concatenate(x) for x in zip(*self.pairs, strict=True)) if self.pairs else (np.empty(0, int), np.empty(0, int))


def parts_of(prints: list[np.ndarray]) -> list[np.ndarray]:
    """The 16-bit parts of 64-bit fingerprints, one after the other."""
    return [(p >> np.uint64(at)).astype(np.uint16) for p in prints for at in range(0, 64, PART_BITS)]


def halves_of(prints: list[np.ndarray]) -> list[np.ndarray]:
    """The two halves of each part, one after the other."""
    return [(p >> np.uint16(at)).astype(np.uint8) for p in parts_of(prints) for at in range(0, PART_BITS, HALF_BITS)]


def leaf_table(tree: list) -> np.ndarray:
    """The leaf of each value of a half: with radius zero there is just one."""
    table = np.zeros(1 << HALF_BITS, np.int64)
    for leaf, values, _ in route(tree, np.arange(1 << HALF_BITS, dtype=np.uint8), 0):
        table[values] = leaf
    return table


def dealt(able: DataFrame, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row ``(task, side, ...)`` for each node ``(node, fp, second, third, n, root)`` and leaf it reaches, more only where a leaf has several blocks.

    Rows of a block meet each other (side 0), or those of another block (sides 1 and 2).
    """
    total = able.count()
    depth = min(PART_BITS, max(0, math.ceil(math.log2(max(1, total) / leaf_rows))))
    sample = able.orderBy(F.xxhash64("node"), "node").select(*PRINTS).limit(SAMPLE_PER_LEAF << depth).collect()
    prints = [np.array([r[k] for r in sample], np.int64).view(np.uint64) for k in range(len(PRINTS))]
    leaves, blocks = [], []
    for values in halves_of(prints):
        leaves.append(leaf_table(fit_tree(values, depth)))
        share = np.bincount(leaves[-1][values], minlength=1 << HALF_BITS) / max(1, len(values))
        blocks.append(np.maximum(1, np.ceil(share * total / block_rows)).astype(np.int64))

    def to_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            mixed = other_bits(columns[0].view(np.uint64))
            for k, half in enumerate(halves_of([c.view(np.uint64) for c in columns[1:]])):
                leaf = leaves[k][half]
                many = blocks[k][leaf]
                own = (mixed % many.astype(np.uint64)).astype(np.int64)
                for other in range(int(many.max(initial=0))):
                    rows = np.flatnonzero(many > other)
                    low, high = np.minimum(own[rows], other), np.maximum(own[rows], other)
                    task = (low * many[rows] + high) << 24 | leaf[rows] << 5 | k
                    at = pa.array(rows)
                    side = np.where(low == high, 0, np.where(own[rows] == low, 1, 2)).astype(np.int8)
                    yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(side), *(c.take(at) for c in batch.columns)], names=["task", "side", *batch.schema.names])

    return able.mapInArrow(to_tasks, "task long, side byte, node long, fp long, second long, third long, n int, root long")


def candidates(nodes: DataFrame, similarity: float, closest: bool, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS, spanning: bool = False) -> DataFrame:
    """Pairs ``(a, b)`` of nodes ``(node, fp, second, third, n, root)`` with different roots.

    All of them, or each node's closest one in each task, and then ``(a, a)`` for nodes that have several in one.
    ``spanning``: not all, but pairs that connect the same nodes, fewer in each task than it has nodes.
    """

    def in_task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)  # a task's smallest nodes are its roots, so tasks name the same pairs
        values = {c: rows[c].to_numpy(np.int64) for c in ("node", *PRINTS, "n", "root")}
        prints = [values[p].view(np.uint64) for p in PRINTS]
        shard = Candidates(prints, parts_of(prints)[(int(key[0]) & 31) // 2], values["n"], values["root"], similarity, closest, spanning)
        side = rows["side"].to_numpy()
        home, visit = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
        if len(home) and len(visit):
            shard.search(home, visit)
        a, b = shard.found(2 if len(side) and side[0] == 0 else 1)  # within a block a pair meets from both sides
        a, b = values["node"][a], values["node"][b]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    able = nodes.where("n >= 4").select("node", *PRINTS, "n", "root")
    return dealt(able, leaf_rows, block_rows).groupBy("task").applyInPandas(in_task, "a long, b long").distinct()


def sets_of(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """``(node, hashes)``: the shingle set of each node of the pairs."""
    wanted = staged(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
    ids = nodes.join(wanted, "node", "left_semi").select(F.col("first_id").alias("_id")).distinct()
    some = sieved(rows, "id", ids).unionByName(rows.where("id is null"))
    texts = some.join(ids, some["id"].eqNullSafe(ids["_id"]), "left_semi")
    return staged(_sets(texts, width).join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have the similarity."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return staged(both.mapInArrow(alike, "a long, b long"), "links")


def connecting_links(rows: pd.DataFrame, across: bool, similarity: float) -> Iterator[tuple[int, int]]:
    """Rows of nodes ``(fp, second, third, root, own, hashes)`` whose sets have the similarity; none between rows that these or the roots join already.

    ``across``: only rows of different blocks are compared.
    """
    prints = [rows[p].to_numpy(np.int64).view(np.uint64) for p in PRINTS]
    sets = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
    sizes, own, root = np.array([len(x) for x in sets]), rows["own"].to_numpy(), np.unique(rows["root"].to_numpy(np.int64), return_inverse=True)[1]
    hashes, places = np.unique(np.concatenate(sets), return_inverse=True)
    places, there = np.split(places, np.cumsum(sizes)[:-1]), np.zeros(len(hashes), bool)
    for a in range(len(sets)):
        b = a + 1 + np.flatnonzero((root[a + 1 :] != root[a]) & ((own[a + 1 :] != own[a]) | (not across)))
        far = sum(np.bitwise_count(p[a] ^ p[b]).astype(np.int64) for p in prints)
        may = allowed(far, sizes[a], sizes[b], similarity)
        b = b[may][np.argsort(far[may], kind="stable")]
        there[places[a]] = True
        while len(b):
            c, b = int(b[0]), b[1:]
            shared = np.count_nonzero(there[places[c]])
            if shared >= similarity * (sizes[a] + sizes[c] - shared) - 1e-9:
                yield a, c
                root[root == root[c]] = root[a]
                b = b[root[b] != root[a]]
        there[places[a]] = False


def verified_kin(kin: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that, with the roots, connect what all links among the nodes ``(node, kin, fp, second, third, n, root)`` of each kin do.

    Kin of several blocks are dealt to a task for each pair of blocks, the others are gathered in tasks of about a block.
    """
    blocks = F.greatest(F.least(F.ceil(F.col("rows") / KIN_ROWS), F.lit(KIN_BLOCKS)), F.ceil(F.col("hashes") / KIN_HASHES)).cast("long")
    sizes = kin.groupBy("kin").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("n").cast("long")).alias("hashes"))
    sizes = staged(sizes.withColumn("blocks", blocks), "kin_sizes")
    n_rows, n_hashes = sizes.where("blocks = 1").agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("hashes"), F.lit(0))).first()
    gathered = max(1, math.ceil(n_rows / KIN_ROWS), math.ceil(n_hashes / KIN_HASHES))
    own = F.pmod(F.xxhash64("node"), "blocks")
    rows = kin.join(sizes.select("kin", "blocks"), "kin").join(sets, "node").withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    task = F.when(F.col("blocks") > 1, F.col("kin")).otherwise(F.pmod(F.xxhash64("kin"), F.lit(gathered)))
    rows = rows.select(task.alias("task"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "kin", "node", *PRINTS, "root", "hashes")

    def in_task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, of in rows.groupby("kin", sort=False):
            node = of["node"].to_numpy(np.int64)
            found += [(node[a], node[b]) for a, b in connecting_links(of, key[1] != key[2], similarity)]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return staged(rows.groupBy("task", "low", "high").applyInPandas(in_task, "a long, b long"), "links")


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    roots = staged(connected_components(links, "a", "b"), "roots")
    return staged(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")


def near_copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(id_col, component_id)``, one row per input row: the smallest id that links reach.

    Texts of ``width`` words or fewer are one shingle; null and empty texts have none and are
    copies of each other. A null id never becomes a component's id unless all of its ids are null.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    every = staged(_nodes(rows, width), "nodes")
    nodes = staged(every.groupBy("node").agg(F.min("id").alias("first_id"), *(F.first(c).alias(c) for c in (*PRINTS, "n"))), "distinct")
    first = staged(candidates(nodes.withColumn("root", F.col("node")), similarity, closest=True), "pairs")
    sets = sets_of(first.where("a <> b"), nodes, rows, width)  # crowded nodes are among these
    links = verified(first.where("a <> b"), sets, similarity)
    rooted = _rooted(nodes, links)
    crowded = rooted.join(first.where("a = b").select(F.col("a").alias("node")), "node", "left_semi")
    second = connected_components(candidates(crowded, similarity, closest=False, spanning=True), "a", "b")
    kin = staged(second.withColumnRenamed("root", "kin"), "kin")
    rooted = _rooted(nodes, links.unionByName(verified_kin(rooted.join(kin, "node"), sets, similarity)))
    lowest = staged(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    groups = rooted.join(lowest, "root").select("node", "component_id")
    return every.join(groups, "node").select(F.col("id").alias(id_col), "component_id")
