"""Near copies against brute force: links at a Jaccard similarity of 0.8 or more, and no others."""

import itertools

import numpy as np
import pytest

import corpus_pipeline
from evigrain.llm import nearcopies
from evigrain.llm.groups import local_roots
from evigrain.llm.staging import staged

DATA = "/root/testdata/sf0.01"


def pair(name, n, similarity):
    """Two texts of ``n`` five-word shingles each whose sets have the similarity or just over it."""
    words = [f"{name}a{i}" for i in range(n + 4)]
    shared = int(np.ceil(round(2 * n * similarity / (1 + similarity), 6)))
    other = words[: shared + 4] + [f"{name}b{i}" for i in range(n - shared)]
    return " ".join(words), " ".join(other)


def jaccard(a, b):
    x, y = set(nearcopies.shingle_set(a, 5).tolist()), set(nearcopies.shingle_set(b, 5).tolist())
    return len(x & y) / len(x | y)


def test_links_are_by_similarity(spark):
    rows, want = [], []
    for similarity in (0.8, 0.82, 0.79, 0.75, 0.6, 0.5):
        for n in (60, 400):
            for k in range(60):
                a, b = pair(f"s{int(similarity * 100)}n{n}k{k}", n, similarity)
                i = len(rows)
                rows += [(i, a), (i + 1, b)]
                want += [i] if jaccard(a, b) >= 0.8 else [i, i + 1]
    for n in (4, 5):  # four of five shingles are a similarity of exactly 0.8
        i = len(rows)
        words = [f"small{n}w{j}" for j in range(9)]
        rows += [(i, " ".join(words)), (i + 1, " ".join(words[:8]))]
        want += [i]
    got = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    assert sorted(r.doc_id for r in got.collect()) == want


def test_a_repeated_passage_counts_once(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(k, " ".join([passage] * 60 + [f"d{k}w{i}" for i in range(40)])) for k in range(3)]
    got = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, 2]


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (None, "a b c d e f g"), (7, "a b c d e f g"), (8, "one"), (9, "ONE"), (9, "ONE")]
    got = nearcopies.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 7), (4, 4), (5, 4), (7, 7), (8, 8), (9, 8), (9, 8)]
    assert nearcopies.near_copy_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def random_nodes(spark, n, groups=0):
    """Nodes of random fingerprints; some of ``groups`` groups, whose members differ in few bits."""
    rng = np.random.default_rng(3)
    prints = rng.integers(-(1 << 63), (1 << 63) - 1, (n, 3))
    for g in range(groups):
        for i in range(g, n, 4 * groups):
            prints[i] = prints[g]
            for at in rng.integers(0, 192, rng.integers(0, 26)).tolist():
                prints[i, at // 64] ^= np.int64(-(1 << 63)) if at % 64 == 63 else np.int64(1 << at % 64)
    rows = [(i, *p, 100, i) for i, p in enumerate(prints.tolist())]
    return rows, spark.createDataFrame(rows, "node long, fp long, second long, third long, n int, root long")


def test_rows_dealt_do_not_grow_with_depth(spark):
    """A node reaches one leaf of each tree, however many leaves there are."""
    rows, nodes = random_nodes(spark, 5000)
    assert nearcopies.dealt(nodes).count() == nearcopies.dealt(nodes, leaf_rows=16).count() == 24 * len(rows)


def test_searches_name_every_pair(spark):
    """The closest ones of all nodes, and all pairs of the crowded ones, are the pairs that are close in a part; with one block and with many."""
    rows, nodes = random_nodes(spark, 900, 9)
    prints = np.array([r[1:4] for r in rows]).view(np.uint64)
    parts = np.stack(nearcopies.parts_of(list(prints.T)))
    want = set()
    for a, b in itertools.combinations(range(len(rows)), 2):
        far = np.bitwise_count(prints[a] ^ prints[b]).astype(int)
        if far[0] <= nearcopies.FIRST_BITS and far.sum() <= nearcopies.MOST_BITS and np.bitwise_count(parts[:, a] ^ parts[:, b]).min() <= 1:
            want.add((a, b))
    assert len(want) > 2000
    for block_rows in (nearcopies.BLOCK_ROWS, 20):
        first = nearcopies.candidates(nodes, 0.8, True, leaf_rows=64, block_rows=block_rows).collect()
        crowded = [r.a for r in first if r.a == r.b]
        second = nearcopies.candidates(nodes.where(nodes.node.isin(crowded)), 0.8, False, leaf_rows=64, block_rows=block_rows).collect()
        got = {(r.a, r.b) for r in first + second if r.a != r.b}
        assert want <= got and len(crowded) < len(rows) / 2


def copies_around_the_bound(n):
    """Texts of 400 words of one family that differ in 2 to 12 words from it: all are candidates of each other, and few pairs reach 0.8."""
    rng = np.random.default_rng(5)
    words = [f"base{i}" for i in range(400)]
    texts = []
    for k in range(n):
        copy = list(words)
        for i in rng.permutation(78)[: 12 - 10 * (k % 7 == 0)].tolist():
            copy[5 * i + 4] = f"k{k}w{i}"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("kin_rows", [128, 20])
def test_a_large_group_lists_no_pairs(spark, monkeypatch, kin_rows):
    """Candidates that don't link: nothing grows with their pairs, and the components are those of all pairs; with few blocks and with many."""
    texts, root = copies_around_the_bound(260), list(range(260))
    sets = [set(nearcopies.shingle_set(t, 5).tolist()) for t in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        shared = len(sets[a] & sets[b])
        if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    assert 50 < len(set(root)) < 255
    counts = []

    def counted(df, name):
        out = staged(df, name)
        counts.append((name, out.count()))
        return out

    monkeypatch.setattr(nearcopies, "staged", counted)
    monkeypatch.setattr(nearcopies, "KIN_ROWS", kin_rows, raising=False)
    got = nearcopies.near_copy_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(root))
    assert max(n for _, n in counts) <= 24 * len(texts), counts


def test_connecting_names_as_much_as_all_pairs(spark):
    """The pairs that connect join the same nodes as all pairs do, in no more rows than each task has nodes."""
    rows, nodes = random_nodes(spark, 900, 9)
    for block_rows in (nearcopies.BLOCK_ROWS, 20):
        every, few = ([(r.a, r.b) for r in nearcopies.candidates(nodes, 0.8, False, leaf_rows=64, block_rows=block_rows, spanning=s).collect()] for s in (False, True))
        roots = []
        for pairs in (every, few):
            a, b = np.array(pairs).T
            roots.append(local_roots(len(rows), a, b).tolist())
        assert roots[0] == roots[1] and len(few) < len(every)
