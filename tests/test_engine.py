import random

import pytest
from pyspark.sql import functions as F
from simulator import INF, Sim

from orbweave.functions.columns import fold
from orbweave.operators import algorithms as alg
from orbweave.operators import engine
from orbweave.operators.graph import Graph

SAMPLE = [(0, 1), (1, 2), (1, 3), (2, 3), (3, 4)]


def graph(spark, edges):
    return Graph(spark.createDataFrame(edges, "src long, dst long"))


def values(run):
    return {r["id"]: r["value"] for r in run.vertices.collect()}


def random_edges(seed):
    rng = random.Random(seed)
    ids = rng.sample([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, INF - 1, INF, INF + 3], 9)
    return [(rng.choice(ids), rng.choice(ids)) for _ in range(rng.randrange(1, 22))]


def test_golden_sample(spark):
    g = graph(spark, SAMPLE)
    pr = engine.run(g, alg.PageRank(), counts=True)
    assert pr.active == [4, 3, 2, 1, 0]
    assert [round(values(pr)[k], 9) for k in range(5)] == [0.85, 0.9775, 0.9233125, 1.061809375, round(1.00927140625, 9)]
    sp = engine.run(g, alg.ShortestPaths(0), counts=True)
    assert (values(sp), sp.active) == ({0: 0, 1: 1, 2: 2, 3: 2, 4: 3}, [1, 2, 1, 0])
    lost = engine.run(g, alg.ShortestPaths(99), counts=True)
    assert (set(values(lost).values()), lost.active) == ({INF}, [0])
    cc = engine.run(g, alg.Components(), counts=True)
    assert (set(values(cc).values()), cc.active) == ({0}, [3, 1, 0])
    core = engine.run(g, alg.KCore(2), counts=True)
    assert (values(core), core.active) == ({0: 1, 1: 2, 2: 2, 3: 2, 4: 1}, [2, 0])


def test_loops_and_parallel_edges(spark):
    g = graph(spark, [*SAMPLE, (3, 4), (2, 2), (7, 7)])
    assert round(values(engine.run(g, alg.PageRank()))[7], 9) == 0.85
    assert values(engine.run(g, alg.ShortestPaths(0)))[7] == INF
    assert values(engine.run(g, alg.Components()))[7] == 7
    core = engine.run(g, alg.KCore(2), counts=True)
    assert (values(core), core.active) == ({0: 1, 1: 2, 2: 2, 3: 4, 4: 2, 7: 0}, [1, 0])


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_against_the_simulator(spark, seed):
    raw = random_edges(seed)
    g, sim = graph(spark, raw), Sim(raw)
    source = raw[0][0]
    for program, dense, (want, active) in (
        (alg.ShortestPaths(source), alg.ShortestPaths(source), sim.sssp(source)),
        (alg.Components(), alg.Components(), sim.cc()),
        (alg.KCore(2), alg.DenseKCore(2), sim.kcore(2)),
    ):
        exact = engine.run(g, program, counts=True)
        assert (values(exact), exact.active) == (want, active)
        assert values(engine.run(g, dense)) == want
    want, active = sim.pagerank(6)
    exact = engine.run(g, alg.PageRank(), counts=True, max_iterations=6)
    assert exact.active == active
    for got in (values(exact), values(engine.run(g, alg.PageRank(), max_iterations=6))):
        assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_caps_truncate(spark):
    chain = [(i, i + 1) for i in range(12)]
    g, sim = graph(spark, chain), Sim(chain)
    assert values(engine.run(g, alg.Components(), max_iterations=3)) == sim.cc(3)[0]
    assert values(engine.run(g, alg.ShortestPaths(0), max_iterations=5)) == sim.sssp(0, 5)[0]
    assert values(engine.run(g, alg.DenseKCore(2), max_iterations=4)) == sim.kcore(2, 4)[0]


def test_reciprocal_pair_counts_twice_and_k_zero_keeps_all(spark):
    g = graph(spark, [(1, 2), (2, 1)])
    assert values(engine.run(g, alg.KCore(2))) == {1: 2, 2: 2}
    assert values(engine.run(g, alg.KCore(0))) == {1: 2, 2: 2}


def test_empty_graph(spark):
    g = graph(spark, [])
    for program in (alg.PageRank(), alg.ShortestPaths(0), alg.Components(), alg.KCore(2)):
        assert engine.run(g, program).vertices.count() == 0


def test_nested_values_and_folded_combiner(spark):
    g = graph(spark, SAMPLE)
    assert {r["id"]: r["distance"] for r in alg.vector_shortest_paths(g, 0).collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 3}

    class Folded(alg.Components):
        op = staticmethod(fold(F.lit(INF).cast("long"), lambda a, b: F.least(a, b)))

    assert values(engine.run(g, Folded())) == {k: 0 for k in range(5)}


def test_rounds_end_when_no_value_changes(spark):
    g = graph(spark, SAMPLE)
    ranks = engine.run(g, alg.PageRank())
    assert ranks.rounds < 32
    assert {k: round(v, 9) for k, v in values(ranks).items()} == {k: round(v, 9) for k, v in Sim(SAMPLE).pagerank(32)[0].items()}
    assert ranks.computing > 0 and ranks.lines()[-1].startswith("Total computing time: ")


def test_skipping_scatter_leaves_results_as_they_are(spark):
    raw = random_edges(7) + random_edges(8)
    g, sim = graph(spark, raw), Sim(raw)
    got = engine.run(g, alg.Components(), counts=True, skip_scatter=True)
    assert values(got) == sim.cc()[0]
    assert got.active[0] >= sim.cc()[1][0]


def test_pandas_functions_in_a_program(spark):
    import pandas as pd

    @F.pandas_udf("long")
    def plus(a: pd.Series, b: pd.Series) -> pd.Series:
        return a + b

    @F.pandas_udf("long")
    def largest(x: pd.Series) -> int:
        return int(x.max())

    class Odd(alg.Components):
        iterations = 1
        gather_uses_vertex = True

        def gather(self, v, nbr):
            return plus(v.id, nbr.value)

        op = staticmethod(largest)

        def total(self, acc):
            return F.coalesce(acc, F.lit(0))

        def apply(self, v, total):
            return total, F.lit(True)

    assert values(engine.run(graph(spark, SAMPLE), Odd())) == {0: 1, 1: 4, 2: 5, 3: 7, 4: 7}


def test_tables_are_discarded(spark):
    from orbweave.functions.tables import discard

    engine.run(graph(spark, SAMPLE), alg.Components())
    assert discard(spark) > 0
    assert discard(spark) == 0


def test_temporary_tables_go(spark):
    from orbweave.functions.tables import Written, discard, temporary

    discard(spark)
    with temporary(spark) as keep:
        Written(spark.range(3).toDF("id"), "a")
        keep.append(Written(spark.range(4).toDF("id"), "b"))
    assert keep[0].df.count() == 4
    assert discard(spark) == 1
