"""The programs that come with the engine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.columns import INFINITY
from orbweave.operators.blocks import Kernel
from orbweave.operators.engine import active, run
from orbweave.operators.graph import Graph
from orbweave.operators.program import Direction, Vertex, VertexProgram


class PageRank(VertexProgram):
    """Ranks ``0.85 + 0.15 * sum(rank / out-degree)`` over in-neighbours, from 1: not normalised, sinks leak."""

    iterations = 32
    acc_init = 0.0
    value_type = "double"
    scatter_uses_neighbor = False
    dense = True

    def init(self, v: Vertex) -> tuple[Column, Column]:
        return F.lit(1.0), F.lit(True)

    def gather(self, v: Vertex, nbr: Vertex) -> Column:
        return nbr.value / nbr.out_degree

    def apply(self, v: Vertex, total: Column) -> tuple[Column, Column]:
        return total * 0.15 + 0.85, F.lit(True)

    def kernel(self) -> Kernel:
        return Kernel(lambda ids: np.ones(len(ids)), lambda v, out: v / np.maximum(out, 1), np.add, 0.0, lambda ids, v, total: total * 0.15 + 0.85, "<f8")

    def counter(self) -> tuple[Kernel, int]:
        """Values are whether a vertex is active: it was reached from an active one."""
        return Kernel(lambda ids: np.ones(len(ids), np.int64), lambda v, out: v, np.maximum, 0, lambda ids, v, total: total, tally=lambda old, new: int(new.sum())), 0


class ShortestPaths(VertexProgram):
    """Hops from ``source`` along edges; INFINITY where it can't be reached in as many rounds."""

    iterations = 64
    acc_init = INFINITY
    dense = True

    def __init__(self, source: int = 0):
        self.source = source

    def init(self, v: Vertex) -> tuple[Column, Column]:
        return F.lit(INFINITY), v.id == self.source

    def gathers(self, v: Vertex) -> Column:
        return v.id != self.source

    def gather(self, v: Vertex, nbr: Vertex) -> Column:
        return nbr.value

    op = staticmethod(F.min)

    def total(self, acc: Column) -> Column:
        return F.least(F.coalesce(acc, self.zero()), self.zero())

    def apply(self, v: Vertex, total: Column) -> tuple[Column, Column]:
        new = F.when(v.id == self.source, F.lit(0)).otherwise(F.least(v.value, total + 1))
        return new, new != v.value

    def scatter(self, v: Vertex, nbr: Vertex) -> Column:
        return v.value + 1 < nbr.value

    def kernel(self) -> Kernel:
        source = self.source
        return Kernel(lambda ids: np.full(len(ids), INFINITY), lambda v, out: v, np.minimum, INFINITY, lambda ids, v, total: np.where(ids == source, 0, np.minimum(v, total + 1)))

    def counter(self) -> tuple[Kernel, int]:
        """Active are those whose value the next round changes."""
        return self.kernel(), 1


class Components(VertexProgram):
    """The smallest id within as many undirected hops as there are rounds; ids above INFINITY count as that."""

    iterations = 32
    acc_init = INFINITY
    gather_edges = Direction.ALL
    scatter_edges = Direction.ALL
    dense = True

    def init(self, v: Vertex) -> tuple[Column, Column]:
        return v.id, F.lit(True)

    def gather(self, v: Vertex, nbr: Vertex) -> Column:
        return nbr.value

    op = staticmethod(F.min)

    def total(self, acc: Column) -> Column:
        return F.least(F.coalesce(acc, self.zero()), self.zero())

    def apply(self, v: Vertex, total: Column) -> tuple[Column, Column]:
        new = F.least(v.value, total)
        return new, new != v.value

    def scatter(self, v: Vertex, nbr: Vertex) -> Column:
        return v.value < nbr.value

    def kernel(self) -> Kernel:
        return Kernel(lambda ids: ids, lambda v, out: v, np.minimum, INFINITY, lambda ids, v, total: np.minimum(v, total))

    def counter(self) -> tuple[Kernel, int]:
        """Active are those whose value the next round changes; ids above INFINITY change in the first one only."""
        return self.kernel(), 1


class KCore(VertexProgram):
    """Peels vertices with fewer than ``k`` living neighbours, in and out together; a dead vertex keeps its last count."""

    iterations = 50
    gather_edges = Direction.ALL
    scatter_edges = Direction.ALL

    def __init__(self, k: int = 0):
        self.k = k

    def init(self, v: Vertex) -> tuple[Column, Column]:
        return F.lit(self.k), F.lit(True)

    def gather(self, v: Vertex, nbr: Vertex) -> Column:
        return (nbr.value >= self.k).cast("long")

    def apply(self, v: Vertex, total: Column) -> tuple[Column, Column]:
        return total, total < self.k

    def scatter(self, v: Vertex, nbr: Vertex) -> Column:
        return nbr.value >= self.k


class DenseKCore(KCore):
    """The same values with all vertices recomputed: the living count their living neighbours, the dead stay."""

    dense = True

    def apply(self, v: Vertex, total: Column) -> tuple[Column, Column]:
        new = F.when(v.value >= self.k, total).otherwise(v.value)
        return new, new != v.value

    def kernel(self) -> Kernel:
        k = self.k
        return Kernel(lambda ids: np.full(len(ids), k), lambda v, out: (v >= k).astype(np.int64), np.add, 0, lambda ids, v, total: np.where(v >= k, total, v))


class VectorShortestPaths(ShortestPaths):
    """Hop counts as one-element arrays: values may be nested."""

    value_type = "array<int>"

    def __init__(self, source: int = 0):
        super().__init__(source)

    def zero(self) -> Column:
        return F.array(F.lit(INFINITY))

    def init(self, v: Vertex) -> tuple[Column, Column]:
        return self.zero(), v.id == self.source

    def apply(self, v: Vertex, total: Column) -> tuple[Column, Column]:
        new = F.when(v.id == self.source, F.array(F.lit(0))).otherwise(F.least(v.value, F.array(total[0] + 1)))
        return new, new != v.value

    def scatter(self, v: Vertex, nbr: Vertex) -> Column:
        return v.value[0] + 1 < nbr.value[0]


def pagerank(graph: Graph, max_iterations: int | None = None) -> DataFrame:
    """(id, rank)."""
    return run(graph, PageRank(), max_iterations=max_iterations).vertices.select("id", F.col("value").alias("rank"))


def shortest_paths(graph: Graph, source: int = 0, max_iterations: int | None = None) -> DataFrame:
    """(id, distance)."""
    return run(graph, ShortestPaths(source), max_iterations=max_iterations).vertices.select("id", F.col("value").alias("distance"))


def vector_shortest_paths(graph: Graph, source: int = 0) -> DataFrame:
    """(id, distance) from the nested program."""
    return run(graph, VectorShortestPaths(source)).vertices.select("id", F.col("value")[0].cast("long").alias("distance"))


def connected_components(graph: Graph, max_iterations: int | None = None) -> DataFrame:
    """(id, component)."""
    return run(graph, Components(), max_iterations=max_iterations).vertices.select("id", F.col("value").alias("component"))


def k_core(graph: Graph, k: int = 0, max_iterations: int | None = None) -> DataFrame:
    """(id, core_value)."""
    return run(graph, DenseKCore(k), max_iterations=max_iterations).vertices.select("id", F.col("value").alias("core_value"))


def iterations(graph: Graph, program: VertexProgram) -> DataFrame:
    """(iteration, active) of a run."""
    return graph.spark.createDataFrame(list(enumerate(active(graph, program))), "iteration long, active long")
