"""Embedding near-duplicates by collision counting over one-dimensional projections.

Unit vectors with cosine c are ``sqrt(2 - 2c)`` apart, so their projections on a random Gaussian direction
differ by a normal variable of that spread. Two vectors *collide* in a projection if one lies in the window
around the other whose half width is that spread at the threshold. Pairs that collide in at least
``needed`` of the projections are verified by their exact cosine; ``needed`` is the largest count that a pair
right at the threshold misses with a chance of at most ``miss`` (a binomial tail), nearer pairs less.

Within a label, vectors are sorted by several projections: into four slabs of even size by the first, each of these by
the next, and so on until slabs hold about ``BLOCK`` vectors, which are sorted by one projection more (in range
partitions, so that no label lies in one task). Ranks in this order, whatever the ranges, deal each label into equal
blocks of at most ``BLOCK``. A block knows the interval that it covers on ``BOXES`` projections. Two blocks meet if they come within 4.5 spreads on each that was sorted by, and 5 on the others: of
vectors without clusters a share that falls with every projection sorted by, of clustered ones few.

Blocks that meet bring their projections only, as half-precision numbers. Windows are counted there as arrays: ``FIRST``
projections for all pairs, the rest for pairs that have collided often enough by then; with all of them hardly any
pair is left that isn't linked. Candidates that are few for their rows go on as pairs of ids and are verified on the
vectors by a join; where they are many, as in a dense group, the two blocks are sent with their vectors, and give for
each vector the number of its links and a spanning forest. So what is shuffled grows with blocks and rows, never with
the pairs of a group.

Equal vectors are one class before all this: its members link to each other and share all other links.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
label, link with nothing (n_links 0, their own component, kept); vectors of different lengths never link;
repeated rows are vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.components import components, contract, forest
from orbweave.llm.store import Written, ready
from orbweave.llm.vectors import keyed

BLOCK = 1024
PROJECTIONS, FIRST = 128, 48
#: Projections whose interval a block keeps, and the most that vectors are sorted by before the last one.
BOXES, SORTED = 16, 7
#: What half precision can change in a difference of two projections.
ROUNDING = 0.004
#: Candidates for each row of two blocks up to which they go on as pairs.
FEW = 2
#: Tasks among which the pairs of a label's blocks are dealt.
SALTS = 32


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, PROJECTIONS))


def needed(n: int, chance: float, miss: float) -> int:
    """The largest count that a binomial (n, chance) stays under with a chance of at most ``miss``."""
    under, k = 0.0, 0
    while k < n and under + comb(n, k) * chance**k * (1 - chance) ** (n - k) <= miss:
        under += comb(n, k) * chance**k * (1 - chance) ** (n - k)
        k += 1
    return k


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def collided(p: np.ndarray, q: np.ndarray, cosine: float, miss: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs between two blocks that collide often enough; ``p`` and ``q``: projections by rows. Each pair once if the blocks are the ``same``."""
    spread, chance = sqrt(2 - 2 * cosine), erf(1 / sqrt(2))
    width = np.float32(spread + ROUNDING)
    least, least_all = needed(FIRST, chance, miss / 2), needed(PROJECTIONS, chance, miss / 2)
    for a in range(0, p.shape[1], 128):
        count = np.zeros((min(128, p.shape[1] - a), q.shape[1]), np.uint8)
        gap, near = np.empty(count.shape, np.float32), np.empty(count.shape, bool)
        for k in range(FIRST):
            np.subtract.outer(p[k, a : a + 128], q[k], out=gap)
            np.abs(gap, out=gap)
            np.less_equal(gap, width, out=near)
            count += near.view(np.uint8)
        i, j = np.nonzero(count >= least)
        if same:
            i, j = i[a + i < j], j[a + i < j]
        total = count[i, j].astype(np.int64)
        for k in range(FIRST, PROJECTIONS):
            total += np.abs(p[k, a + i] - q[k, j]) <= width
        yield a + i[total >= least_all], j[total >= least_all]


def blocked(classes: DataFrame) -> DataFrame:
    """(id, grp, dim, lo, hi, keys, sizes, ps, vs): blocks of neighbours on several projections."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = b.column(2).to_pylist()
            dims = np.array([len(v) // 8 for v in vs], np.int32)
            ps = np.zeros((len(vs), PROJECTIONS), np.float16)
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                ps[mine] = (unit(np.frombuffer(b"".join(vs[i] for i in mine), "<f8").reshape(len(mine), -1)) @ directions(int(dim))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims), pa.array([x.tobytes() for x in ps], pa.binary()), pa.array(ps[:, : SORTED + 1].astype(np.float64).tolist(), pa.list_(pa.float64()))], names=["grp", "k1", "v", "copies", "dim", "ps", "at"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        made, of = 0, None
        schema = pa.schema([("id", pa.int64()), ("grp", pa.int64()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("keys", pa.binary()), ("sizes", pa.binary()), ("ps", pa.binary()), ("vs", pa.binary())])

        def flush() -> pa.RecordBatch:
            nonlocal held, made
            made += 1
            raw = b"".join(r["ps"] for r in held)
            box = np.frombuffer(raw, np.float16).reshape(len(held), -1)[:, :BOXES].astype(np.float64)
            row = {"id": (TaskContext.get().partitionId() << 32) + made, "grp": held[0]["grp"], "dim": held[0]["dim"], "lo": box.min(0).tolist(), "hi": box.max(0).tolist(), "keys": np.array([r["k1"] for r in held], "<i8").tobytes(), "sizes": np.array([r["copies"] for r in held], "<i8").tobytes(), "ps": raw, "vs": b"".join(r["v"] for r in held)}
            held = []
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            for r in b.to_pylist():
                if held and of != (r["grp"], r["dim"], r["block"]):
                    yield flush()
                held.append(r)
                of = r["grp"], r["dim"], r["block"]
        if held:
            yield flush()

    projected = Written(classes.select("grp", "k1", "v", "copies").mapInArrow(project, "grp long, k1 long, v binary, copies long, dim int, ps binary, at array<double>"), "projected").df
    quarters = F.array(*[F.percentile_approx(F.col("at")[k], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000) for k in range(SORTED)])
    labels = projected.groupBy("grp", "dim").agg(F.count("*").alias("n"), quarters.alias("cuts"))
    labels = labels.withColumn("levels", F.least(F.lit(SORTED), F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / BLOCK) / F.log(F.lit(4.0))))).cast("int")).drop("n")
    joined = projected.join(labels, ["grp", "dim"])
    cell = F.lit(0).cast("long")
    for k in range(SORTED):
        slab = sum((F.col("at")[k] > F.col("cuts")[k][c]).cast("long") for c in range(3))
        cell = cell * 4 + F.when(F.col("levels") > k, slab).otherwise(0)
    placed = joined.withColumn("cell", cell).withColumn("last", F.col("at")[F.col("levels")]).select("grp", "dim", "cell", "last", "k1")
    order = ["grp", "dim", "cell", "last"]
    laid = Written(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()), "laid").df.withColumn("part", F.shiftright("row", 33))
    # one row for each label in each range
    runs = laid.groupBy("grp", "dim", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    label = Window.partitionBy("grp", "dim")
    runs = runs.withColumn("before", F.sum("n").over(label.orderBy("part")) - F.col("n")).withColumn("all", F.sum("n").over(label))
    size = F.ceil(F.col("all") / F.ceil(F.col("all") / BLOCK))
    ranked = laid.join(runs.select("grp", "dim", "part", "first", "before", size.alias("size")), ["grp", "dim", "part"])
    key = ["grp", "dim", "block"]
    at = ranked.withColumn("block", F.floor((F.col("row") - F.col("first") + F.col("before")) / F.col("size"))).select(*key, "k1")
    # vectors move only now, by class and then by block
    dealt = at.join(projected.select("k1", "v", "copies", "ps"), "k1").select(*key, "k1", "v", "copies", "ps")
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(cut, "id long, grp long, dim int, lo array<double>, hi array<double>, keys binary, sizes binary, ps binary, vs binary")


def near_duplicates(rows: DataFrame, cosine: float = 0.93, miss: float = 1e-4) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``rows`` (vec_id, embedding, label)."""
    ready(rows.sparkSession)
    all_ = Written(keyed(rows, F.col("label")), "vectors").df
    takes_part = F.col("v").isNotNull() & F.col("grp").isNotNull() & F.col("vec_id").isNotNull()
    classes = Written(all_.filter(takes_part).groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"), F.first("grp").alias("grp"), F.first("v").alias("v")), "classes").df
    blocks = Written(blocked(classes), "blocks").df
    meta = ["id", "grp", "dim", "lo", "hi"]
    x = blocks.select(*meta).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    y = blocks.select(*[F.col(c).alias(c + "2") for c in meta]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = sqrt(2 - 2 * cosine)
    close = F.lit(True)
    for k in range(BOXES):
        reach = (4.5 if k <= SORTED else 5) * spread + ROUNDING
        close = close & (F.col("lo2")[k] <= F.col("hi")[k] + reach) & (F.col("lo")[k] <= F.col("hi2")[k] + reach)
    # the metadata of blocks, a thousandth of the rows, dealt to SALTS tasks a label
    pairs = x.join(y.withColumnsRenamed({"grp2": "grp", "dim2": "dim"}), ["grp", "dim", "salt"]).filter((F.col("id") <= F.col("id2")) & close).select("id", "id2")

    def with_blocks(pairs: DataFrame, *columns: str) -> DataFrame:
        load = [blocks.select(F.col("id").alias(f"id{s}"), *(F.col(c).alias(c + s) for c in columns)) for s in ("", "2")]
        return pairs.join(load[0], "id").join(load[1], "id2").select("id", "id2", *(c + s for s in ("", "2") for c in columns))

    def numbers(raw: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(raw, np.float16).reshape(-1, PROJECTIONS).T.astype(np.float32))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r].as_py() for n in ("id", "id2", "keys", "ps", "keys2", "ps2")}
                k, k2 = (np.frombuffer(row[c], "<i8") for c in ("keys", "keys2"))
                u, v, many = [], [], False
                for i, j in collided(numbers(row["ps"]), numbers(row["ps2"]), cosine, miss, row["id"] == row["id2"]):
                    u.append(k[i])
                    v.append(k2[j])
                    if many := sum(map(len, u)) > FEW * (len(k) + len(k2)):
                        break
                none = pa.nulls(1, pa.int64())
                if many:
                    yield pa.RecordBatch.from_arrays([pa.array([row["id"]]), pa.array([row["id2"]]), none, none], names=["id", "id2", "u", "v"])
                elif sum(map(len, u)):
                    u, v = np.concatenate(u), np.concatenate(v)
                    none = pa.nulls(len(u), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(u), pa.array(v)], names=["id", "id2", "u", "v"])

    asked = Written(with_blocks(pairs, "keys", "ps").mapInArrow(candidates, "id long, id2 long, u long, v long"), "candidates").df

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r].as_py() for n in ("id", "id2", "keys", "sizes", "ps", "vs", "keys2", "sizes2", "ps2", "vs2")}
                k, k2, n, n2 = (np.frombuffer(row[c], "<i8") for c in ("keys", "keys2", "sizes", "sizes2"))
                x, y = (unit(np.frombuffer(row[c], "<f8").reshape(m, -1)) for c, m in (("vs", len(k)), ("vs2", len(k2))))
                out, out2 = np.zeros(len(k), np.int64), np.zeros(len(k2), np.int64)
                a, c = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for i, j in collided(numbers(row["ps"]), numbers(row["ps2"]), cosine, miss, row["id"] == row["id2"]):
                    ok = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
                    i, j = i[ok], j[ok]
                    np.add.at(out, i, n2[j])
                    np.add.at(out2, j, n[i])
                    a, c = forest(np.concatenate([a, k[i]]), np.concatenate([c, k2[j]]))
                if not out.any():
                    continue
                nodes = np.concatenate([k[out > 0], k2[out2 > 0], a])
                links = np.concatenate([out[out > 0], out2[out2 > 0], np.zeros(len(a), np.int64)])
                ends = np.concatenate([k[out > 0], k2[out2 > 0], c])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(ends), pa.array(links)], names=["u", "v", "links"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = b.column("v1").to_pylist(), b.column("v2").to_pylist()
            ok = np.zeros(b.num_rows, bool)
            size = np.array([len(v) for v in xs])
            for n in np.unique(size):
                mine = np.flatnonzero(size == n)
                x, y = (unit(np.frombuffer(b"".join(z[i] for i in mine), "<f8").reshape(len(mine), -1)) for z in (xs, ys))
                ok[mine] = np.einsum("ij,ij->i", x, y) >= cosine
            u, v, n, m = (b.column(c).to_numpy()[ok] for c in ("u", "v", "n1", "n2"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, v])), pa.array(np.concatenate([v, u])), pa.array(np.concatenate([m, n]))], names=["u", "v", "links"])

    dense = with_blocks(asked.filter("id IS NOT NULL").select("id", "id2"), "keys", "sizes", "ps", "vs").mapInArrow(compare, "u long, v long, links long")
    known = [classes.select(F.col("k1").alias(c), F.col("v").alias(f"v{s}"), F.col("copies").alias(f"n{s}")) for c, s in (("u", "1"), ("v", "2"))]
    sparse = asked.filter("id IS NULL").select("u", "v").join(known[0], "u").join(known[1], "v").mapInArrow(verify, "u long, v long, links long")
    found = Written(dense.unionAll(sparse), "links").df
    joined = components(contract(found.filter("u <> v").select("u", "v")))
    counts = found.groupBy("u").agg(F.sum("links").alias("links"))
    of = classes.select("k1", "k2", "copies", "rep").join(joined.withColumnRenamed("node", "k1"), "k1", "left").withColumn("component", F.coalesce("component", "k1"))
    least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = of.join(least, "component").join(counts.withColumnRenamed("u", "k1"), "k1", "left").select("k1", "k2", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    done = Written(named, "named").df.withColumn("part", F.lit(True))
    own = all_.select("vec_id", "k1", "k2", takes_part.alias("part"))
    out = own.join(done, ["k1", "k2", "part"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
