"""Bulk-synchronous gather, apply and scatter over DataFrames.

A round is a join of the edges with the vertices' values, an aggregation with partial sums, and a join back;
Spark picks broadcast or shuffled joins by size, splits skewed partitions and combines before shuffling, so a
vertex of very high degree needs no special care. Values of a round are written to the shared folder and read
by the next, which keeps plans short and survives lost executors.

Two ways to run, with the same values:

* *frontier*: as programs define it; only active vertices apply, and a scatter phase finds the next ones.
  Gives the counts of active vertices.
* *dense*, for programs that allow it: all vertices apply in every round. Rounds need no scatter phase and
  several of them are planned as one job. The edges lie in buckets of the end that is looked up, so a round
  shuffles messages and values only. A round that leaves every value as it was is the last one. Programs with a
  ``kernel`` run on arrays instead (``blocks``), with the same values; some count their active vertices there too.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.tables import Written
from orbweave.operators import blocks
from orbweave.operators.graph import Graph
from orbweave.operators.program import Direction, Vertex, VertexProgram

log = logging.getLogger("orbweave")

#: Rounds planned as one job in a dense run. Each round refers to the previous one twice; shuffles are reused, but plans take longer to make.
STRIDE = 4


@dataclass
class Run:
    """``vertices``: (id, value, in_degree, out_degree). ``active``: vertices active after each round, if counted.

    ``loading`` and ``computing``: seconds until the first round, and in the rounds.
    """

    vertices: DataFrame
    rounds: int
    active: list[int] | None
    loading: float = 0.0
    computing: float = 0.0

    def lines(self) -> list[str]:
        """The run as lines of a benchmark log, which ``sources.reports.bench_average`` reads."""
        rounds = [f"Iteration: {i}, global_active vertices: {n}" for i, n in enumerate(self.active or [])]
        return [f"Loading time: {self.loading:f} (s)", *rounds, f"Total computing time: {self.computing:f} (s)"]

    def stats(self) -> DataFrame:
        """(iteration, active), iterations from 0."""
        return self.vertices.sparkSession.createDataFrame(list(enumerate(self.active or [])), "iteration long, active long")


def _of(prefix: str, change: bool = False) -> Vertex:
    return Vertex(*(F.col(f"{prefix}_{c}") for c in ("id", "value", "in_degree", "out_degree")), change=F.col(f"{prefix}_change") if change else None)


def _as(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def _oriented(edges: DataFrame, way: Direction) -> DataFrame:
    """(v_id, nbr_id): the neighbours of v along these edges, each as often as it is one."""
    coming = edges.select(F.col("dst").alias("v_id"), F.col("src").alias("nbr_id"))
    going = edges.select(F.col("src").alias("v_id"), F.col("dst").alias("nbr_id"))
    return {Direction.IN: coming, Direction.OUT: going, Direction.ALL: coming.unionAll(going)}[way]


def gather(program: VertexProgram, edges: DataFrame, state: DataFrame, frontier: DataFrame | None = None, met: DataFrame | None = None) -> DataFrame:
    """(id, acc): what each vertex - of the ``frontier`` (id), if given - gathers from its neighbours.

    ``met``: the edges as (v_id, nbr_id) in the direction of the program, if they are at hand.
    """
    if program.gather_edges is Direction.NONE:
        return state.select("id", F.lit(None).cast(program.value_type).alias("acc")).limit(0)
    plain = state.select("id", "value", "in_degree", "out_degree")
    met = _oriented(edges, program.gather_edges) if met is None else met
    if frontier is not None:
        met = met.join(frontier.select(F.col("id").alias("v_id")), "v_id", "left_semi")
    met = met.join(_as(plain, "nbr"), "nbr_id")
    if program.gather_uses_vertex:
        met = met.join(_as(plain, "v"), "v_id")
    message = program.gather(_of("v"), _of("nbr"))
    return met.select("v_id", message.alias("message")).groupBy(F.col("v_id").alias("id")).agg(program.op(F.col("message")).alias("acc"))


def apply(program: VertexProgram, state: DataFrame, gathered: DataFrame, active: Column, exact: bool = False) -> DataFrame:
    """``state`` with new values of the active vertices, and ``change``: as the program says, or if ``exact`` whether the value is another."""
    both = _as(state, "v").join(gathered.withColumnRenamed("id", "v_id"), "v_id", "left")
    v = _of("v")
    total = F.when(program.gathers(v), program.total(F.col("acc"))).otherwise(program.zero())
    value, change = program.apply(v, total)
    new = F.when(active, value).otherwise(v.value).cast(program.value_type)
    if exact:
        change = ~new.eqNullSafe(v.value)
    return both.select(
        F.col("v_id").alias("id"),
        new.alias("value"),
        F.col("v_in_degree").alias("in_degree"),
        F.col("v_out_degree").alias("out_degree"),
        (active & change).alias("change"),
    )


def scatter(program: VertexProgram, edges: DataFrame, state: DataFrame) -> DataFrame:
    """(id): the vertices that the changed ones of ``state`` activate, each once."""
    if program.scatter_edges is Direction.NONE:
        return state.select("id").limit(0)
    v = _of("v", change=True)
    senders = _as(state, "v").filter(program.scatters(v))
    met = _oriented(edges, program.scatter_edges).join(senders, "v_id")
    if program.scatter_uses_neighbor:
        met = met.join(_as(state.drop("change"), "nbr"), "nbr_id")
    return met.filter(program.scatter(v, _of("nbr"))).select(F.col("nbr_id").alias("id")).distinct()


def initial(program: VertexProgram, graph: Graph) -> DataFrame:
    """(id, value, in_degree, out_degree, active) before the first round."""
    start = _as(graph.degrees.withColumn("value", F.lit(None)), "v")
    value, active = program.init(_of("v"))
    return start.select(F.col("v_id").alias("id"), value.cast(program.value_type).alias("value"), F.col("v_in_degree").alias("in_degree"), F.col("v_out_degree").alias("out_degree"), active.alias("active"))


def run(graph: Graph, program: VertexProgram, counts: bool = False, max_iterations: int | None = None, skip_scatter: bool = False) -> Run:
    """Run ``program`` to its end or its cap (or ``max_iterations``); at least one round is run.

    ``skip_scatter``, for programs that may be ``dense``: a round with counts whose changed vertices have over half of
    all edges (or all of them, if messages go both ways) activates every vertex instead of looking for the next ones.
    """
    cap = max(1, program.iterations if max_iterations is None else max_iterations)
    began = time.monotonic()
    dense = program.dense and not counts
    kernel = program.kernel() if dense and "kernel" in vars(type(program)) else None
    raw = _whole(graph) if kernel else None
    if raw:
        loaded = time.monotonic()
        vertices, rounds, _ = blocks.run(raw[0].df, kernel, raw[1], program.gather_edges is Direction.ALL, cap, program.value_type)
        raw[0].drop()
        return Run(vertices.df, rounds, None, loaded - began, time.monotonic() - loaded)
    edges = Written(_oriented(graph.edges, program.gather_edges), "edges", by="nbr_id") if dense else Written(graph.edges, "edges")
    first = Written(initial(program, graph), "vertices")
    loaded = time.monotonic()
    done = _dense(program, edges.df, first, cap) if dense else _frontier(program, edges.df, first, cap, skip_scatter and program.dense)
    edges.drop()
    done.loading, done.computing = loaded - began, time.monotonic() - loaded
    log.info("%s: %d rounds, loading %.3f s, computing %.3f s", type(program).__name__, done.rounds, done.loading, done.computing)
    return done


def _whole(graph: Graph) -> tuple[Written, int] | None:
    """The raw edges in a table, and their number; nothing if an end of one is null, which arrays don't hold."""
    raw = Written(graph.raw, "edges")
    n, src, dst = raw.df.agg(F.count("*"), F.count("src"), F.count("dst")).first()
    if n == src == dst:
        return raw, n
    raw.drop()
    return None


def active(graph: Graph, program: VertexProgram) -> list[int]:
    """The numbers of active vertices after each round, as of a run with ``counts``."""
    counter = program.counter() if "counter" in vars(type(program)) else None
    raw = _whole(graph) if counter else None
    if not raw:
        return run(graph, program, counts=True).active
    kernel, lag = counter
    vertices, _, tallies = blocks.run(raw[0].df, kernel, raw[1], program.gather_edges is Direction.ALL, program.iterations + lag, "long")
    raw[0].drop()
    vertices.drop()
    tallies += tallies[-1:] * (program.iterations + lag - len(tallies))  # it ended where nothing changes any more
    counts = tallies[lag:] or [0]
    return counts[: counts.index(0) + 1] if 0 in counts else counts


def _dense(program: VertexProgram, met: DataFrame, now: Written, cap: int) -> Run:
    done = 0
    while done < cap:
        step = min(STRIDE, cap - done)
        state = now.df.select("id", "value", "in_degree", "out_degree")
        for k in range(step):
            new = apply(program, state, gather(program, met, state, met=met), F.lit(True), exact=k == step - 1)
            state = new if k == step - 1 else new.drop("change")
        written = Written(state, "vertices")
        now.drop()
        now, done = written, done + step
        log.debug("round %d", done)
        if now.df.filter("change").isEmpty():
            break  # had any earlier round of this job changed nothing, the last one changed nothing either
    return Run(now.df.drop("change"), done, None)


def _frontier(program: VertexProgram, edges: DataFrame, now: Written, cap: int, skip: bool = False) -> Run:
    frontier: Written | None = None
    active: list[int] = []
    all_edges = edges.count() if skip else 0
    for _ in range(cap):
        state = now.df
        if frontier is not None:
            state = state.drop("change").join(frontier.df.withColumn("active", F.lit(True)), "id", "left").withColumn("active", F.coalesce("active", F.lit(False)))
        here = state.filter("active").select("id")
        gathered = gather(program, edges, state, here)
        applied = Written(apply(program, state, gathered, F.col("v_active")), "vertices")
        everyone = False
        if skip:
            ends = {Direction.NONE: F.lit(0), Direction.IN: F.col("in_degree"), Direction.OUT: F.col("out_degree"), Direction.ALL: F.col("in_degree") + F.col("out_degree")}[program.scatter_edges]
            busy = applied.df.filter("change").agg(F.sum(ends)).first()[0] or 0
            everyone = busy > all_edges * (1 if program.scatter_edges is Direction.ALL else 0.5)
        found = Written(applied.df.select("id") if everyone else scatter(program, edges, applied.df), "frontier")
        now.drop()
        if frontier is not None:
            frontier.drop()
        now, frontier = applied, found
        active.append(found.df.count())
        log.debug("round %d: %d active vertices", len(active) - 1, active[-1])
        if not active[-1]:
            break
    return Run(now.df.drop("change"), len(active), active)
