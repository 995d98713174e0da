"""Column expressions of the vertex-program model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: "Not reached" and the neutral element of minimum; a number, not NULL, in every result.
INFINITY = 1 << 30

#: The colours of the DOT writer, in the order in which labels get them.
PALETTE = ("red", "orange", "yellow", "green", "cyan", "blue", "purple", "black")


def partition_of(vertex: Column, parts: int) -> Column:
    """The partition that owns a vertex; never negative."""
    return F.pmod(vertex, F.lit(parts))


def fold(zero: Column, merge: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    """A combiner from any commutative and associative ``merge``, for programs whose combiner Spark lacks.

    It gathers a vertex's messages in one array first, so its memory grows with the vertex's degree; prefer a
    built-in aggregate wherever one fits.
    """
    return lambda message: F.aggregate(F.collect_list(message), zero, merge)


def neighbor_list(neighbor: str) -> Column:
    """Aggregate: the sorted neighbours, repeats included, as a comma-joined string."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(neighbor)), lambda x: x.cast("string")), ",")


def dot_line(vertex: Column, color: Column | str) -> Column:
    return F.format_string("  %d [front=white, color=%s]", vertex, F.lit(color) if isinstance(color, str) else color)
