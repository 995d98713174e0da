"""Vertex programs: what a user writes, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import IntFlag
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbweave.operators.blocks import Kernel


class Direction(IntFlag):
    NONE = 0
    IN = 1
    OUT = 2
    ALL = 3


@dataclass(frozen=True)
class Vertex:
    """The columns of a vertex that an expression may use; ``change`` only in the scatter phase."""

    id: Column
    value: Column
    in_degree: Column
    out_degree: Column
    change: Column | None = None


class VertexProgram:
    """Subclass and override. Expressions must be deterministic.

    ``op`` aggregates messages and must be commutative and associative, with ``acc_init`` as its neutral
    element: that is folded in once, and stands for the messages of a vertex that has none.
    """

    #: The most rounds. A run that hits it returns what it has, converged or not.
    iterations: int = 1
    acc_init: Any = 0
    #: Spark type of a value
    value_type: str = "long"
    gather_edges: Direction = Direction.IN
    scatter_edges: Direction = Direction.OUT
    #: Whether ``gather`` uses its first argument; if not, one join a round is saved.
    gather_uses_vertex: bool = False
    #: Whether ``scatter`` uses its second argument.
    scatter_uses_neighbor: bool = True
    #: Whether applying a vertex that isn't active would leave its value as it is. Then a run that needs no
    #: counts of active vertices recomputes all of them, and needs no scatter phase.
    dense: bool = False

    def kernel(self) -> Kernel | None:
        """The same round on arrays, for a ``dense`` program; only the class that defines it uses it, not those derived from it."""
        return None

    def counter(self) -> tuple[Kernel, int] | None:
        """A kernel whose tallies, from the given one on, are the numbers of active vertices after each round; as ``kernel``."""
        return None

    def init(self, v: Vertex) -> tuple[Column, Column]:
        """First value, and whether the vertex is active in the first round."""
        raise NotImplementedError

    def gathers(self, v: Vertex) -> Column:
        """Which vertices gather at all; the others apply ``acc_init``."""
        return F.lit(True)

    def gather(self, v: Vertex, nbr: Vertex) -> Column:
        raise NotImplementedError

    op: Callable[[Column], Column] = staticmethod(F.sum)

    def total(self, acc: Column) -> Column:
        """The aggregate with ``acc_init`` folded in; ``acc`` is null without messages."""
        return F.coalesce(acc, self.zero())

    def zero(self) -> Column:
        return self.acc_init if isinstance(self.acc_init, Column) else F.lit(self.acc_init).cast(self.value_type)

    def apply(self, v: Vertex, total: Column) -> tuple[Column, Column]:
        """New value, and whether the vertex changed."""
        raise NotImplementedError

    def scatters(self, v: Vertex) -> Column:
        return v.change

    def scatter(self, v: Vertex, nbr: Vertex) -> Column:
        """Whether the neighbour is active in the next round."""
        return F.lit(True)
