"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Largest inner products are made nearest points: with R the largest norm of all vectors, ``x`` becomes
``(x, sqrt(R^2 - |x|^2))``, whose distance from ``(q, 0)`` falls as the product rises. Distinct vectors go to the cell
of their nearest centroid (``cells``: k-means on a bounded sample, at most ``CELLS``), and a cell with more than
``SHARD`` of them is dealt by hash to shards of about that size. A shard's graph has levels of geometrically falling size; on each
level a point's links are chosen from its nearest points there (found by block products, since a shard is
small) by the usual rule that a link must be nearer to its point than to any link chosen before, and links
run both ways. The graph is kept as flat arrays: vectors, and for each level its members and their
neighbours, ``-1`` for none.

A search goes greedily down to the lowest level and there keeps the ``beam`` best points, expanding the best
unexpanded ones until none is left; a block of queries advances together. All points of a beam are scored
exactly, in double precision on the original vectors, and the ``k + 1`` best of each shard merged, ties to smaller ids.

A graph is tried when it is made (``width``): queries of the calibration that visit its shard, and vectors of the shard
itself, are searched and compared with all vectors of the shard. If a beam, or twice its width, doesn't find the share
``found`` of both groups' neighbours (many ties, norms of very different sizes, many dimensions without clusters), the
shard is scanned: its queries are multiplied with all its vectors, a bounded block at a time.

A query visits the shards of the cells that are nearest to it: as many cells as hold the share ``found`` of the true
neighbours of ``CALIBRATE`` queries, drawn by a hash of their ids and compared with every vector (``probes``). Where
vectors have no clusters that is nearly all cells. A shard's graph is sent once for every ``TOGETHER`` blocks of queries.

Equal vectors are one point of a graph, standing for the ``k + 1`` smallest ids that have it (no other can be
among a query's k nearest), so copies cost nothing and crowd nobody out.

Every vector is indexed. Edge cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, take no part; vectors of another length than most are compared only with
their like; repeated ids are candidates of their own, except for the query of the same id; fewer candidates
than k give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.store import Written, below_rate, ready
from orbweave.llm.vectors import keyed

SHARD = 8192
LINKS = 16
POOL = 64
QUERIES = 1024
#: The most cells, the vectors that centroids are fitted on, and the queries that say how many cells to visit.
CELLS, SAMPLE, CALIBRATE = 1024, 8192, 200
#: Blocks of queries that one copy of a shard's graph serves.
TOGETHER = 8
#: Vectors of a shard that its graph is tried with, and the queries that are scanned at once.
TRIED, SCANNED = 64, 256


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest others of each row, nearest first, and their squared distances."""
    sq = (x * x).sum(1)
    ids, far = np.empty((len(x), k), np.int32), np.empty((len(x), k), np.float32)
    for a in range(0, len(x), 512):
        d = sq[a : a + 512, None] + sq[None] - 2 * x[a : a + 512] @ x.T
        d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
        top = np.argpartition(d, k - 1, 1)[:, :k] if k < len(x) else np.argsort(d, 1)[:, :k]
        near = np.take_along_axis(d, top, 1)
        order = np.lexsort((top, near), axis=1)
        ids[a : a + 512], far[a : a + 512] = np.take_along_axis(top, order, 1), np.take_along_axis(near, order, 1)
    return ids, far


def _links(x: np.ndarray, most: int, above: np.ndarray) -> np.ndarray:
    """Links of each row: diverse near points, both ways, at most ``most``; -1 where there are fewer.

    A quarter of those that a row chooses is left for its nearest rows of the sparser level ``above``, as in a dense
    group all the nearest ones are of that group.
    """
    n = len(x)
    if n < 2:
        return np.full((n, most), -1, np.int32)
    near, far = _nearest(x, min(POOL, n - 1))
    dense = near.shape[1]
    if len(above):
        d = (x * x).sum(1)[:, None] + (x[above] * x[above]).sum(1)[None] - 2 * x @ x[above].T
        d[above, np.arange(len(above))] = np.inf
        top = np.argsort(d, 1, kind="stable")[:, : POOL // 4]
        near, far = np.concatenate([near, above[top]], 1), np.concatenate([far, np.take_along_axis(d, top, 1)], 1)
    pool = near.shape[1]
    chosen = np.zeros((n, pool), bool)
    for a in range(0, n, 1024):
        y = x[near[a : a + 1024]]
        sq = (y * y).sum(2)
        between = sq[:, :, None] + sq[:, None] - 2 * y @ y.transpose(0, 2, 1)
        own, blocked = far[a : a + 1024], np.zeros(near[a : a + 1024].shape, bool)
        took = np.zeros(len(own), np.int64)
        for t in range(pool):
            ok = ~blocked[:, t] & (took < (most // 2 if t >= dense or not len(above) else most // 2 - most // 8)) & np.isfinite(own[:, t])
            chosen[a : a + 1024, t] = ok
            took += ok
            blocked |= ok[:, None] & (between[:, t] < own)
    src, col = np.nonzero(chosen)
    dst, d = near[src, col].astype(np.int64), far[src, col]
    key = np.concatenate([src * n + dst, dst * n + src])
    key, first = np.unique(key, return_index=True)
    d = np.concatenate([d, d])[first]
    src, dst = key // n, key % n
    order = np.lexsort((dst, d, src))
    src, dst = src[order], dst[order]
    rank = np.arange(len(src)) - np.searchsorted(src, src)
    out = np.full((n, most), -1, np.int32)
    keep = rank < most
    out[src[keep], rank[keep]] = dst[keep]
    return out


class Graph:
    """Flat arrays of one shard: points, and per level (lowest first) its members and their links as point numbers."""

    def __init__(self, x: np.ndarray, height: np.ndarray):
        self.x = np.ascontiguousarray(x, np.float32)
        self.members, self.links = [], []
        for level in range(int(height.max(initial=0)) + 1):
            members = np.flatnonzero(height >= level).astype(np.int32)
            links = _links(self.x[members], 2 * LINKS if not level else LINKS, np.flatnonzero(height[members] > level))
            self.members.append(members)
            self.links.append(np.where(links >= 0, members[links], -1).astype(np.int32))

    def search(self, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, point number) of the ``k`` best found for each query."""
        q = q.astype(np.float32)
        now = np.full(len(q), self.members[-1][0], np.int64)
        sq = (self.x * self.x).sum(1)

        def away(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
            return sq[points] - 2 * np.einsum("amd,ad->am", self.x[points], q[rows])

        best = away(np.arange(len(q)), now[:, None])[:, 0]
        for level in range(len(self.members) - 1, 0, -1):
            at = np.zeros(len(self.x), np.int64)
            at[self.members[level]] = np.arange(len(self.members[level]))
            todo = np.arange(len(q))
            while len(todo):
                near = self.links[level][at[now[todo]]].astype(np.int64)
                d = np.where(near >= 0, away(todo, near), np.inf)
                c = d.argmin(1)
                low = d[np.arange(len(todo)), c]
                ok = low < best[todo]
                now[todo[ok]], best[todo[ok]] = near[np.flatnonzero(ok), c[ok]], low[ok]
                todo = todo[ok]
        ids, dist, done = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), np.inf, np.float32), np.ones((len(q), beam), bool)
        ids[:, 0], dist[:, 0], done[:, 0] = now, best, False
        seen = np.zeros((len(q), len(self.x)), bool)
        seen[np.arange(len(q)), now] = True
        todo, wide = np.arange(len(q)), 4
        while len(todo):
            # beams are sorted, so the first unexpanded ones are the nearest
            order = np.argsort(done[todo], 1, kind="stable")[:, :wide]
            fresh = ~np.take_along_axis(done[todo], order, 1)
            go = fresh.any(1)
            todo, order, fresh = todo[go], order[go], fresh[go]
            if not len(todo):
                break
            points = np.where(fresh, ids[todo[:, None], order], -1)
            done[todo[:, None], order] = True
            near = np.where(points[:, :, None] >= 0, self.links[0][points], -1).reshape(len(todo), -1).astype(np.int64)
            near.sort(1)
            again = np.zeros(near.shape, bool)
            again[:, 1:] = near[:, 1:] == near[:, :-1]
            near[again | (near < 0) | seen[todo[:, None], near]] = -1
            r, c = np.nonzero(near >= 0)
            seen[todo[r], near[r, c]] = True
            d = np.full(near.shape, np.inf, np.float32)
            d[r, c] = sq[near[r, c]] - 2 * np.einsum("ij,ij->i", self.x[near[r, c]], q[todo[r]])
            all_d, all_i, all_done = np.concatenate([dist[todo], d], 1), np.concatenate([ids[todo], near], 1), np.concatenate([done[todo], near < 0], 1)
            top = np.argpartition(all_d, beam - 1, 1)[:, :beam]
            top = np.take_along_axis(top, np.argsort(np.take_along_axis(all_d, top, 1), 1), 1)
            dist[todo], ids[todo] = np.take_along_axis(all_d, top, 1), np.take_along_axis(all_i, top, 1)
            done[todo] = np.take_along_axis(all_done, top, 1) | ~np.isfinite(dist[todo])
        r, c = np.nonzero((ids[:, :k] >= 0) & np.isfinite(dist[:, :k]))
        return r, ids[r, c]

    def parts(self) -> tuple[list[bytes], list[bytes]]:
        return [m.tobytes() for m in self.members], [x.tobytes() for x in self.links]

    @classmethod
    def of(cls, x: np.ndarray, members: list[bytes], links: list[bytes]) -> Graph:
        g = cls.__new__(cls)
        g.x = np.ascontiguousarray(x, np.float32)
        g.members = [np.frombuffer(m, np.int32) for m in members]
        g.links = [np.frombuffer(y, np.int32).reshape(len(m), -1) for m, y in zip(g.members, links, strict=True)]
        return g


def lifted(v: np.ndarray, largest: float) -> np.ndarray:
    """Vectors as points whose distance from a query's falls as their product with it rises."""
    v = v / largest
    return np.concatenate([v, np.sqrt(np.maximum(1 - (v * v).sum(1, keepdims=True), 0))], 1)


def asked(q: np.ndarray) -> np.ndarray:
    """Queries as points."""
    return np.concatenate([q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300), np.zeros((len(q), 1))], 1)


def cells(x: np.ndarray, n: int, steps: int = 8) -> np.ndarray:
    """``n`` centroids of points by k-means, from evenly spread ones; a centroid without points stays where it is."""
    c = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(steps):
        of = nearest_cells(x, c, 1)[:, 0]
        size = np.bincount(of, minlength=n)
        order = np.argsort(of, kind="stable")
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        full = size > 0
        c[full] = np.add.reduceat(x[order], begin[full], 0) / size[full, None]
    return c


def nearest_cells(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each point, nearest first."""
    d = (c * c).sum(1)[None] - 2 * x @ c.T
    return np.argsort(d, 1, kind="stable")[:, :n] if n > 1 else d.argmin(1)[:, None]


def points(v: np.ndarray) -> np.ndarray:
    """A shard's vectors as points, lifted by its own largest norm: single precision is lost beside far larger ones."""
    return lifted(v, np.linalg.norm(v, axis=1).max())


def foremost(at: np.ndarray, point: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` rows of each query ``at`` with the largest scores, ties to smaller points."""
    order = np.lexsort((point, -score, at))
    at, point, score = at[order], point[order], score[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], point[keep], score[keep]


def product(q: np.ndarray, v: np.ndarray, at: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Inner products of pairs, the same whichever pairs are asked for together."""
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[at[a : a + 65536]], v[point[a : a + 65536]]) for a in range(0, len(at), 65536))])


def scan(v: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, point number, score) of the ``k`` largest products of each query, ties to smaller points."""
    found, k, norm = [], min(k, len(v)), np.linalg.norm(v, axis=1).max()
    for a in range(0, len(q), SCANNED):
        part = q[a : a + SCANNED]
        s = part @ v.T
        least = np.partition(s, len(v) - k, 1)[:, len(v) - k]
        at, point = np.nonzero(s >= (least - 1e-12 * norm * np.linalg.norm(part, axis=1))[:, None])
        at, point, score = foremost(at, point, product(part, v, at, point), k)
        found.append((at + a, point, score))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def walk(g: Graph, v: np.ndarray, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, of the points that a search with ``beam`` ends with."""
    at, point = g.search(asked(q), beam, beam)
    return foremost(at, point, product(q, v, at, point), k)


def width(g: Graph, v: np.ndarray, tries: list[np.ndarray], k: int, beam: int, found: float) -> int:
    """The beam with which the graph finds the share ``found`` of the ``k`` best of each group of queries; 0 if none does."""
    sure = [(q, scan(v, q, k)) for q in tries if len(q)]
    for wide in (beam, 2 * beam):
        if all(np.isin(at * len(v) + point, got[0] * len(v) + got[1]).mean() >= found for q, (at, point, _) in sure for got in [walk(g, v, q, k, wide)]):
            return wide
    return 0


def index(placed: DataFrame, tests: np.ndarray, centroids: np.ndarray, visit: int, k: int, beam: int, found: float) -> DataFrame:
    """(shard, dim, beam, keys, vs, members, links): a graph per shard over ``placed`` (k1, first, v, shard, dim), or none and a beam of 0.

    Points are numbered by ``first``, the smallest id that has the vector.
    """
    shared = placed.sparkSession.sparkContext.broadcast((tests, nearest_cells(asked(tests), centroids, len(centroids))[:, :visit] if len(tests) else None, centroids.shape[1] - 1))

    def build(table: pa.Table) -> pa.Table:
        tests, visited, wide = shared.value
        k1 = table.column("k1").to_numpy()
        order = np.argsort(table.column("first").to_numpy(), kind="stable")
        vs = table.column("v").to_pylist()
        raw = b"".join(vs[i] for i in order)
        v = np.frombuffer(raw, "<f8").reshape(len(k1), -1)
        x = points(v)
        draw = ((k1[order].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
        height = np.minimum((-np.log(np.minimum(draw, 1)) / np.log(LINKS)).astype(np.int64), 8)
        g = Graph(x, height)
        own = v[np.unique(np.linspace(0, len(v) - 1, TRIED).astype(int))]
        cell = table.column("shard")[0].as_py() % CELLS
        theirs = tests[(visited == cell).any(1)] if len(tests) and v.shape[1] == wide else tests[:0]
        fit = width(g, v, [own, theirs], k + 1, max(beam, k + 1), found)
        members, links = g.parts() if fit else ([], [])
        first = table.slice(0, 1)
        return pa.table([first.column("shard"), first.column("dim"), pa.array([fit], pa.int32()), pa.array([k1[order].tobytes()]), pa.array([raw]), pa.array([members], pa.list_(pa.binary())), pa.array([links], pa.list_(pa.binary()))], names=["shard", "dim", "beam", "keys", "vs", "members", "links"])

    return placed.select("shard", "dim", "k1", "first", "v").groupBy("shard", "dim").applyInArrow(build, "shard int, dim int, beam int, keys binary, vs binary, members array<binary>, links array<binary>")


def drawn(queries: DataFrame, dim: int) -> np.ndarray:
    """At most CALIBRATE of the ``queries`` (vec_id, v)."""
    vs = queries.select("v").orderBy(F.xxhash64("vec_id", F.lit(3)), "v").limit(CALIBRATE).toArrow().column("v").to_pylist()
    return np.array([np.frombuffer(v, "<f8") for v in vs]).reshape(len(vs), dim)


def probes(classes: DataFrame, q: np.ndarray, centroids: np.ndarray, k: int, found: float) -> int:
    """How many cells a query visits so that these hold the share ``found`` of the k nearest ``classes`` (v, cell).

    By the true neighbours, in double precision, of the queries ``q``.
    """
    if not len(q):
        return 1
    shared = classes.sparkSession.sparkContext.broadcast(q)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        top, of = np.full((len(q), k + 1), -np.inf), np.full((len(q), k + 1), -1)
        for b in batches:
            if not b.num_rows:
                continue
            v = np.frombuffer(b"".join(b.column(0).to_pylist()), "<f8").reshape(b.num_rows, -1)
            s, c = np.concatenate([top, q @ v.T], 1), np.concatenate([of, np.broadcast_to(b.column(1).to_numpy(), (len(q), b.num_rows))], 1)
            at = np.argpartition(-s, k, 1)[:, : k + 1]
            top, of = np.take_along_axis(s, at, 1), np.take_along_axis(c, at, 1)
        i, j = np.nonzero(of >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(top[i, j]), pa.array(of[i, j].astype(np.int32))], names=["q", "score", "cell"])

    near = classes.select("v", "cell").mapInArrow(best, "q int, score double, cell int")
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc()))).filter(F.col("r") <= k + 1)
    got = first.groupBy("q", "cell").agg(F.count("*").alias("n")).toArrow()
    order = nearest_cells(asked(q), centroids, len(centroids))
    place = np.argsort(order, 1)
    held = np.bincount(place[got.column("q").to_numpy(), got.column("cell").to_numpy()], got.column("n").to_numpy(), len(centroids))
    return int(np.searchsorted(np.cumsum(held) / held.sum(), found - 1e-12)) + 1


def search(rows: DataFrame, is_query: Column, k: int = 20, beam: int = 192, shard: int = SHARD, found: float = 0.995) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``rows`` (vec_id, embedding) with ``is_query``."""
    spark = rows.sparkSession
    ready(spark)
    all_ = Written(keyed(rows.filter(F.col("vec_id").isNotNull()), F.lit(0)).filter(F.col("v").isNotNull()), "vectors").df
    by_age = Window.partitionBy("k1", "k2").orderBy("vec_id")
    members = Written(all_.select("k1", "k2", "vec_id").withColumn("nth", F.row_number().over(by_age)).filter(F.col("nth") <= k + 1), "members").df
    dim = (F.length("v") / 8).cast("int")
    classes = Written(all_.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.min("vec_id").alias("first")).withColumn("dim", dim), "classes").df

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([float(np.linalg.norm(np.frombuffer(v, "<f8"))) for v in b.column(0).to_pylist()], pa.float64())], names=["dim", "norm"])

    size = classes.select("v", "dim").mapInArrow(norms, "dim int, norm double").groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("most")).orderBy(F.col("n").desc(), "dim")
    main = size.first()
    largest = size.agg(F.max("most")).first()[0] or 1.0
    wide, n = (main["dim"], main["n"]) if main else (0, 0)
    count = min(CELLS, max(1, -(-n // shard)))
    centroids = np.zeros((1, wide + 1))
    if count > 1:
        sample = classes.filter(F.col("dim") == wide).filter(below_rate(F.col("k1"), 4, SAMPLE / n)).select("k1", "v").toArrow().sort_by("k1")
        centroids = cells(lifted(np.array([np.frombuffer(v, "<f8") for v in sample.column("v").to_pylist()]), largest), min(count, sample.num_rows))
    shared = spark.sparkContext.broadcast(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = np.zeros(b.num_rows, np.int32)
            mine = np.flatnonzero(b.column(2).to_numpy() == wide)
            if len(mine) and len(shared.value) > 1:
                vs = b.column(1).to_pylist()
                of[mine] = nearest_cells(lifted(np.array([np.frombuffer(vs[i], "<f8") for i in mine]), largest), shared.value, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of)], names=["k1", "v", "dim", "first", "cell"])

    celled = Written(classes.select("k1", "v", "dim", "first").mapInArrow(place, "k1 long, v binary, dim int, first long, cell int"), "cells").df
    # a row for each cell, and for each other length of vectors
    parts = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"))
    whole = celled.filter(F.col("dim") == wide).groupBy("cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts")).toArrow()
    of_cell = dict(zip(whole.column("cell").to_pylist(), whole.column("parts").to_pylist(), strict=True))  # at most CELLS
    placed = celled.join(parts, ["dim", "cell"]).withColumn("shard", (F.col("cell") + CELLS * F.pmod(F.xxhash64("k1", F.lit(2)), F.col("parts"))).cast("int"))
    queries = all_.filter(is_query).select("vec_id", "v")
    tests = drawn(queries.filter(dim == wide), wide)
    visit = 1 if len(centroids) == 1 else probes(celled.filter(F.col("dim") == wide), tests, centroids, k, found)
    graphs = Written(index(placed, tests, centroids, visit, k, beam, found), "graphs").df

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
        total = made = 0

        def flush(where: tuple[int, int]) -> pa.RecordBatch:
            nonlocal total, made
            got = held.pop(where)
            total, made = total - len(got), made + 1
            at = (TaskContext.get().partitionId() << 32) + made
            return pa.RecordBatch.from_arrays([pa.array([where[0]], pa.int32()), pa.array([where[1]], pa.int32()), pa.array([at], pa.int64()), pa.array([np.array([i for i, _ in got], "<i8").tobytes()]), pa.array([b"".join(v for _, v in got)])], names=["dim", "cell", "at", "ids", "qs"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                near = [0]
                if len(v) // 8 == wide and len(shared.value) > 1:
                    near = nearest_cells(asked(np.frombuffer(v, "<f8")[None]), shared.value, visit + 1)[0, :visit].tolist()
                for c in near:
                    held.setdefault((len(v) // 8, c), []).append((i, v))
                    total += 1
                    if len(held[len(v) // 8, c]) == QUERIES:
                        yield flush((len(v) // 8, c))
                while total > 8 * QUERIES:
                    yield flush(max(held, key=lambda x: len(held[x])))
        for where in sorted(held):
            yield flush(where)

    blocks = Written(queries.mapInArrow(gather, "dim int, cell int, at long, ids binary, qs binary"), "queries").df
    met = blocks.join(parts, ["dim", "cell"]).withColumn("shard", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: (F.col("cell") + CELLS * p).cast("int"))))
    copies = met.groupBy("shard", "dim").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("copies"))
    none = F.lit(None)
    sent = graphs.join(copies, ["shard", "dim"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("shard", "dim", "copy", none.cast("binary").alias("ids"), none.cast("binary").alias("qs"), "beam", "keys", "vs", "members", "links")
    put = met.join(copies, ["shard", "dim"]).select("shard", "dim", F.pmod(F.xxhash64("at"), F.col("copies")).cast("int").alias("copy"), "ids", "qs", none.cast("int").alias("beam"), none.cast("binary").alias("keys"), none.cast("binary").alias("vs"), none.cast("array<binary>").alias("members"), none.cast("array<binary>").alias("links"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, fit, key, v = None, 0, np.zeros(0, np.int64), np.zeros((0, 0))
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in ("dim", "ids", "qs", "beam", "keys", "vs", "members", "links")}
                if row["keys"] is not None:  # a shard's graph comes before its queries
                    key, v = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["vs"], "<f8").reshape(-1, row["dim"])
                    fit = row["beam"]
                    g = Graph.of(points(v), row["members"], row["links"]) if fit else None
                    continue
                ids, q = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["qs"], "<f8").reshape(-1, row["dim"])
                at, point, score = walk(g, v, q, k + 1, fit) if g else scan(v, q, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(key[point]), pa.array(score)], names=["query_id", "k1", "score"])

    both = sent.unionAll(put).repartition("shard", "dim", "copy").sortWithinPartitions("shard", "dim", "copy", F.col("keys").isNull())
    hits = both.mapInArrow(run, "query_id long, k1 long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    merged = Written(hits.withColumn("r", F.rank().over(nearest)).filter(F.col("r") <= k + 1), "found").df  # ties stay
    named = merged.join(members.select("k1", "vec_id"), "k1").filter("vec_id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return named.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
