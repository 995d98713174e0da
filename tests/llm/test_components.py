import random

import pytest

from orbweave.llm.components import components


def brute(edges):
    label = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
    return label


SHAPES = {
    "path": [(k, k + 1) for k in range(300)],
    "path in any order": random.Random(1).sample([(k * 7 % 301, (k + 1) * 7 % 301) for k in range(300)], 300),
    "star": [(500, k) for k in range(400)],
    "negative ids, loops, repeats": [(-5, 3), (3, -5), (3, 3), (9, 9), (3, 8), (1 << 62, -(1 << 62))],
    "random": [(random.Random(k).randrange(400), random.Random(k + 9000).randrange(400)) for k in range(300)],
    "nothing": [],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components(spark, shape):
    edges = SHAPES[shape]
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "u long, v long").repartition(5)
    got = {r.node: r.component for r in components(df).collect()}
    want = brute(edges)
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_after_one_round_equal_names_are_connected(spark):
    edges = SHAPES["path in any order"] + [(1000, 1001)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    want = brute(edges)
    for r in components(df, rounds=1).collect():
        assert want[r.node] == want[r.component] and r.component <= r.node
