"""Links between members of buckets, whatever a bucket's size, with output linear in the members.

A bucket is cut into blocks of bounded size by a hash of its members, and every two blocks of a bucket meet in
one group, so that no task holds a bucket and no pair goes unseen. A group gives a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.components import forest
from orbweave.llm.store import Written, ready

#: Members and shingles in a block, about.
MEMBERS, SHINGLES = 2048, 1 << 19
#: Small groups are compared together up to so many members.
SMALL = 512
ROWS = 256
#: Shingles that more members share than this are counted by products, others pair by pair.
COMMON = 16


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least labels after members ``i`` and ``j`` are joined."""
    if not len(i):
        return label
    u, v = forest(label[i], label[j])
    if not len(u):
        return label
    to = np.arange(len(label))
    to[u] = v
    return to[label]


def spanning(hit: np.ndarray, label: np.ndarray, top: int, left: int) -> np.ndarray:
    """Labels after members ``top + row`` and ``left + column`` are joined wherever ``hit`` is true; rows at a time."""
    for a in range(0, len(hit), ROWS):
        part = hit[a : a + ROWS] & (label[top + a : top + a + len(hit[a : a + ROWS]), None] != label[None, left : left + hit.shape[1]])
        i, j = np.nonzero(part)
        label = merged(label, top + a + i, left + j)
    return label


def blocked(rows: DataFrame, totals: DataFrame, keys: list[str], member: Column, first: Column, blocks: Column, others: Column) -> DataFrame:
    """``rows`` of the keys in ``totals``, once for each two blocks that meet: with block, pa and pb (pa <= pb).

    A member's block is ``first`` plus a hash of it modulo ``blocks``; it meets the blocks below ``others``.
    """
    placed = rows.join(totals, keys).withColumn("block", first + F.pmod(F.xxhash64(member, F.lit(31)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others.cast("int") - 1)))
    return placed.withColumn("pa", F.least("block", "other")).withColumn("pb", F.greatest("block", "other")).drop("other")


def common(h: list[np.ndarray], m: int) -> np.ndarray:
    """How many values the sets ``h[:m]`` (rows) share with ``h[m:]`` (columns); with m = 0, all with all, above the diagonal at least."""
    n = len(h)
    size = np.array([len(x) for x in h])
    rows, start = (m, m) if m else (n, 0)
    shared = np.zeros((rows, n - start), np.float32)
    values = np.concatenate(h)
    member = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")  # members of a value are in order
    values, member = values[order], member[order]
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    count = np.diff(np.append(begin, len(values)))
    of = np.repeat(np.arange(len(begin)), count)
    few = count[of] <= COMMON
    f_of, f_member = of[few & (count[of] > 1)], member[few & (count[of] > 1)]
    for d in range(1, COMMON):
        same = np.flatnonzero(f_of[d:] == f_of[:-d]) if len(f_of) > d else np.zeros(0, np.int64)
        if not len(same):
            break
        x, y = f_member[same], f_member[same + d]
        ok = (x < rows) & (y >= start)
        shared += np.bincount(x[ok] * (n - start) + y[ok] - start, minlength=shared.size).reshape(shared.shape)
    many = np.flatnonzero(count > COMMON)
    for a in range(0, len(many), 2048):
        some = many[a : a + 2048]
        column = np.full(len(begin), -1)
        column[some] = np.arange(len(some))
        c = column[of]
        z = np.zeros((n, len(some)), np.float32)
        z[member[c >= 0], c[c >= 0]] = 1
        shared += z[:rows] @ z[start:].T
    return shared


def alike(h: list[np.ndarray], m: int, similarity: float) -> np.ndarray:
    """Which of the sets ``h[:m]`` and ``h[m:]`` have this Jaccard similarity; with m = 0, of all with all, above the diagonal."""
    size = np.array([len(x) for x in h])
    x, y = (size[:m], size[m:]) if m else (size, size)
    shared = common(h, m)
    return (shared > 0) & (shared >= similarity * (x[:, None] + y[None] - shared) - 1e-9)


def similar_sets(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): what connects the labels of members that share a value and have sets of this Jaccard similarity.

    ``members`` (value, k, label), ``sets`` (k, h: sorted distinct 64-bit values as bytes). Every two members of a
    value are compared exactly, but for those that have its most frequent label both. Members of a label count as
    connected, and a group gives at most a row for each of its labels.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(rows: list[tuple], cross: bool) -> pa.RecordBatch | None:
            if not cross:  # members of several values may meet here, and one member more than once
                rows = list({r[4]: r for r in rows}.values())
            label = np.unique(np.array([r[5] for r in rows]), return_inverse=True)[1]
            if len(rows) < 2 or label.max() == 0:
                return None
            m = sum(r[3] == rows[0][3] for r in rows) if cross else 0
            hit = alike([np.frombuffer(r[6], np.uint64) for r in rows], m, similarity)
            # members of a label count as joined
            firsts = np.unique(label, return_index=True)[1]
            joined = spanning(hit, firsts[label], 0, m)
            moved = np.flatnonzero(joined[firsts] != firsts)
            if not len(moved):
                return None
            k = np.array([r[4] for r in rows])
            ends = firsts[moved]
            return pa.RecordBatch.from_arrays([pa.array(k[ends]), pa.array(k[joined[ends]])], names=["u", "v"])

        held: list[tuple] = []
        begin = 0  # where the group that is being read begins
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("value", "pa", "pb", "block", "k", "label", "h")), strict=True):
                if held and row[:3] != held[-1][:3]:
                    if held[-1][1] != held[-1][2]:
                        if (out := linked(held[begin:], True)) is not None:
                            yield out
                        held = held[:begin]
                    begin = len(held)
                    if begin >= SMALL or (held and row[1] != row[2]):
                        if (out := linked(held, False)) is not None:
                            yield out
                        held, begin = [], 0
                held.append(row)
        if held and held[-1][1] != held[-1][2]:
            if (out := linked(held[begin:], True)) is not None:
                yield out
            held = held[:begin]
        if held and (out := linked(held, False)) is not None:
            yield out

    ready(members.sparkSession)
    sized = members.join(sets.select("k", (F.length("h") / 8).cast("long").alias("n")), "k")
    per = sized.groupBy("value", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    top = F.max(F.struct("c", "s", "label"))
    totals = per.groupBy("value").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("kinds"), top.alias("top")).filter("kinds > 1")

    def number(c: Column, s: Column) -> Column:
        return F.greatest(F.ceil(c / MEMBERS), F.ceil(s / SHINGLES)).cast("int")

    one = F.col("top.c") > 1  # otherwise every member has a label of its own
    totals = totals.select(
        "value",
        F.when(one, F.col("top.label")).alias("major"),
        F.when(one, number(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s"))).otherwise(number(F.col("c"), F.col("s"))).alias("rest"),
        F.when(one, number(F.col("top.c"), F.col("top.s"))).otherwise(0).alias("majors"),
    )
    totals = Written(totals, "totals").df
    is_major = F.coalesce(F.col("label") == F.col("major"), F.lit(False))
    placed = blocked(members, totals, ["value"], F.col("k"), F.when(is_major, F.col("rest")).otherwise(0), F.when(is_major, F.col("majors")).otherwise(F.col("rest")), F.when(is_major, F.col("rest")).otherwise(F.col("rest") + F.col("majors")))
    met = placed.select("value", "pa", "pb", "block", "k", "label").join(sets, "k").repartition("value", "pa", "pb").sortWithinPartitions("value", "pa", "pb", "block")
    return Written(met.select("value", "pa", "pb", "block", "k", "label", "h").mapInArrow(meet, "u long, v long"), "met").df
