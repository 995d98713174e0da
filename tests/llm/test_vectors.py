import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import embedding_dedup, hnsw
from orbweave.llm.embedding_dedup import near_duplicates, needed


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, k1 string")


def sample(n=702, dim=24, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2] + 0.25 * rng.standard_normal((n - n // 2, dim)).astype(np.float32)
    x[5] = x[9] = x[14]
    rows = [(k, x[k].tolist(), int(k % 3), "clash") for k in range(n)]
    bad = [(n, None, 1, ""), (n + 1, [0.0] * dim, 1, ""), (n + 2, [float("nan")] * dim, 1, ""), (n + 3, [None, 1.0], 1, ""), (n + 4, x[5].tolist(), None, ""), (n + 5, [float("inf")] + [1.0] * (dim - 1), 2, "")]
    return x.astype(np.float64), rows, bad


def test_needed_is_a_binomial_tail():
    assert needed(48, 0.6827, 1e-4) == 20
    assert needed(10, 0.5, 0.0) == 0


@pytest.mark.parametrize(("block", "few"), [(64, 2), (16, 0), (8, 100)])
def test_embedding_near_duplicates(spark, monkeypatch, block, few):
    """Links, counts and components against brute force, with up to three sorted projections; all candidates as pairs, and all in blocks."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "FEW", few)
    x, rows, bad = sample()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.93 - 1e-12) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(near, comp[None], len(x)).min(1))
        if (new == comp).all():
            break
        comp = new
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(table(spark, rows + bad).repartition(3)).collect()}
    assert near.sum() > 100
    for k in range(len(x)):
        assert got[k] == (near[k].sum(), comp[k], comp[k] == k)
    for r in bad:
        assert got[r[0]] == (0, r[0], True)
    assert near_duplicates(table(spark, [])).count() == 0


def test_search(spark, monkeypatch):
    x, rows, bad = sample()
    df = table(spark, rows + bad).repartition(3)
    got: dict[int, list] = {}
    for r in hnsw.search(df, F.col("vec_id") % 20 == 0, shard=256).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    every = np.concatenate([x, x[5:6]])
    ids = np.array([*range(len(x)), len(x) + 4])
    hits = total = 0
    for q in range(0, len(x), 20):
        s = every @ x[q]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 21))
        assert [v for _, v, _ in mine] == [v for v, _ in sorted(((v, s) for _, v, s in mine), key=lambda t: (-t[1], t[0]))]
        for _, v, score in mine:
            assert abs(score - every[np.flatnonzero(ids == v)[0]] @ x[q]) < 1e-12
        hits += len({v for _, v, _ in mine} & set(ids[order].tolist()))
        total += 20
    assert hits / total >= 0.95
    few = table(spark, rows[:3] + bad)
    assert sorted((r["rank"], r.vec_id) for r in hnsw.search(few, F.col("vec_id") == 0).collect())[0][0] == 1
    assert hnsw.search(few, F.col("vec_id") == 0).count() == 3
    assert hnsw.search(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_search_visits_few_cells_where_there_are_clusters(spark, monkeypatch):
    """Shards at several cells, one cell of several shards, thousands of near-equal vectors: recall against brute force."""
    rng = np.random.default_rng(9)
    centre = rng.standard_normal((12, 32)) * 3
    x = np.concatenate([centre[rng.integers(0, 12, 2000)] + rng.standard_normal((2000, 32)), centre[3] + 0.01 * rng.standard_normal((1200, 32))]).astype(np.float32)
    visited = []
    probes = hnsw.probes
    monkeypatch.setattr(hnsw, "probes", lambda *a: visited.append(probes(*a)) or visited[-1])
    df = table(spark, [(k, v.tolist(), 0, "") for k, v in enumerate(x)]).repartition(4)
    got: dict[int, list] = {}
    for r in hnsw.search(df, F.col("vec_id") % 20 == 0, shard=256).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    every = x.astype(np.float64)
    hits = 0
    for q in range(0, len(x), 20):
        s = every @ every[q]
        s[q] = -np.inf
        hits += len(set(got[q]) & set(np.argsort(-s)[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9
    assert len(got) == len(range(0, len(x), 20)) and all(len(v) == 20 for v in got.values())
    assert visited[0] < 10


@pytest.mark.parametrize("kind", ["norms", "ties", "wide"])
def test_search_of_vectors_that_are_hard_for_a_graph(spark, kind):
    """A few norms far above the others, products with many ties, many dimensions without clusters: the ids of brute force, ties to the smaller."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, {"norms": 24, "ties": 16, "wide": 192}[kind]))
    x = {"norms": np.concatenate([x, 1e5 * x[:2]]), "ties": np.sign(x), "wide": x}[kind].astype(np.float32)
    got: dict[int, list] = {}
    for r in hnsw.search(table(spark, [(k, v.tolist(), 0, "") for k, v in enumerate(x)]).repartition(4), F.col("vec_id") % 20 == 0, shard=1000).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    every = x.astype(np.float64)
    hits = 0
    for q in range(0, len(x), 20):
        order = [k for k in np.lexsort((np.arange(len(x)), -(every @ every[q]))) if k != q][:20]
        hits += len(set(got[q]) & set(order))
    assert hits / (20 * len(got)) >= 0.98
