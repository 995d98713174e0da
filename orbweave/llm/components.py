"""Connected components of an undirected edge table, as tables only.

Alternating large-star and small-star rounds: each keeps the components and turns them into stars around
their smallest node in a logarithmic number of rounds, whatever their shape. A round is an aggregation with
partial sums and an equi-join, so a node with very many neighbours is combined before the shuffle and its
join partition can be split by adaptive execution; no group is ever gathered in one task. Before each round,
every partition contracts its own edges to a spanning forest, which usually leaves little to do. As soon as no more
than ``AT_ONCE`` edges are left (16 MB), one task contracts them all, which is the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.store import Written, ready

#: Edges contracted at a time, so that a task's memory is bounded.
AT_ONCE = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the edges u-v, as edges from each node to its component's smallest: at most one a node."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contract(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v: the spanning forest of each partition's edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += len(held[-1][0])
            if n >= AT_ONCE:
                held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
                if n >= AT_ONCE // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["u", "v"])
                    held, n = [], 0
        if n:
            u, v = forest(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    ready(edges.sparkSession)
    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").mapInArrow(run, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Join what hangs on a node - its larger neighbours, or its smaller ones and itself - to its smallest neighbour."""
    both = edges if not large else edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component): each node of ``edges`` (u, v) and the smallest node reachable from it.

    After only so many ``rounds``, if given, components may still be in parts: a node may have several rows,
    each naming a smaller node of its component, and only equal names say that two nodes are connected.

    Direction, repeats and loops don't matter; a node that has only loops isn't listed; null ends are
    ignored. An empty table gives an empty result.
    """
    now = Written(contract(edges), "edges")
    last, done = None, 0
    while True:
        state = now.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == last or done == rounds:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct().unionAll(now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last, done = state, done + 1
        if state["n"] <= AT_ONCE // 2:
            step = Written(contract(now.df.coalesce(1)), "edges")
            now.drop()
            now, rounds = step, done
            continue
        for large in (True, False):
            step = Written(contract(_star(now.df, large)).distinct(), "edges")
            now.drop()
            now = step
