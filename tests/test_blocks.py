import random

import pytest
from simulator import Sim
from test_engine import random_edges, values

from orbweave.operators import algorithms as alg
from orbweave.operators import blocks, engine
from orbweave.operators.graph import Graph


def graph(spark, edges):
    return Graph(spark.createDataFrame(edges, "src long, dst long").repartition(3))


def shapes():
    rng = random.Random(5)
    yield [(i, i + 1) for i in range(90) if i % 30 != 29] + [(200, 200), (200, 200)]
    yield [(rng.randrange(12), rng.randrange(12)) for _ in range(70)] + [(3, 100 + i) for i in range(40)] * 2
    yield random_edges(7) + random_edges(8) + [(-5, 1), (1, -5)]


@pytest.mark.parametrize(("shape", "most"), [(0, 1 << 21), (1, 1 << 21), (2, 1 << 21), (0, 64), (1, 100)])
def test_blocks_against_the_simulator(spark, monkeypatch, shape, most):
    """One block and several, blocks compacted while they load; values, degrees and counts of active vertices."""
    monkeypatch.setattr(blocks, "EDGES", most)
    monkeypatch.setattr(blocks, "PACKED", 20)
    edges = list(shapes())[shape]
    g, sim = graph(spark, edges), Sim(edges)
    source = edges[0][0]
    for program, (want, _) in ((alg.ShortestPaths(source), sim.sssp(source)), (alg.Components(), sim.cc()), (alg.DenseKCore(2), sim.kcore(2)), (alg.PageRank(), sim.pagerank())):
        run = engine.run(g, program)
        assert {k: round(v, 9) for k, v in values(run).items()} == {k: round(v, 9) for k, v in want.items()}
        assert {r.id: (r.in_degree, r.out_degree) for r in run.vertices.collect()} == {v: (len(sim.inn[v]), len(sim.out[v])) for v in sim.ids}
    for program, (_, want) in ((alg.Components(), sim.cc()), (alg.PageRank(), sim.pagerank())):
        assert [tuple(r) for r in alg.iterations(g, program).collect()] == list(enumerate(want))
    if most > 1 << 20:
        source = edges[-1][0]
        assert engine.active(g, alg.ShortestPaths(source)) == sim.sssp(source)[1]


def test_rounds_send_no_tables_to_the_driver(spark, monkeypatch):
    """No plan of a run on blocks broadcasts: rounds look nothing up."""
    plans = []
    written = blocks.Written

    def spy(df, *args, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, *args, **kw)

    monkeypatch.setattr(blocks, "Written", spy)
    monkeypatch.setattr(engine, "Written", spy)
    assert alg.iterations(graph(spark, [(i, i + 1) for i in range(50)]), alg.Components()).count() == 32
    assert plans and not any("Broadcast" in p or "Join" in p for p in plans)


def test_null_ends_are_left_to_columns(spark):
    got = values(engine.run(graph(spark, [(1, 2), (None, 2), (2, 3)]), alg.ShortestPaths(1)))
    assert {k: v for k, v in got.items() if k is not None} == {1: 0, 2: 1, 3: 2}
