"""The similarity join against all pairs: scattered sets, groups of near copies over several blocks, ties at the threshold."""

import random

import pytest

from evigrain.operators.relational import similar_pairs, token_sets


@pytest.mark.parametrize(("least", "width"), [(0.8, 128), (0.8, 3), (0.6, 4), (0.7, 2)])
def test_against_all_pairs(spark, least, width):
    chance = random.Random(11)
    bases = [[f"w{chance.randrange(90)}" for _ in range(n)] for n in (5, 9, 10, 18, 30, 40)]
    texts = [[w if chance.random() > 0.07 else f"v{chance.randrange(300)}" for w in chance.choice(bases)] + [f"w{chance.randrange(90)}" for _ in range(chance.randrange(3))] for _ in range(260)]
    texts += [["a", "b", "c", "d"], ["a", "b", "c", "d", "e"], list("abcdefg"), list("abcdefghij"), [], ["a", "b", "c", "d"]]
    cells = ["x" if chance.random() < 0.7 else None for _ in texts]
    sets = {}
    for i, (t, c) in enumerate(zip(texts, cells, strict=True)):
        if t and (frozenset(t), c) not in sets.values():
            sets[i] = (frozenset(t), c)
    want = {}
    for i, (s, c) in sets.items():
        for j, (t, d) in sets.items():
            if i < j and c == d and len(s & t) / len(s | t) >= least:
                want[i, j] = len(s & t) / len(s | t)
    rows = spark.createDataFrame([(i, c, t) for i, (t, c) in enumerate(zip(texts, cells, strict=True))], "id long, cell string, words array<string>")
    found = similar_pairs(token_sets(rows, "id", ["cell"], "words"), ["cell"], least, width).collect()
    assert len(found) == len(want) > 100 and {(r.left_id, r.right_id): r.similarity for r in found} == want
