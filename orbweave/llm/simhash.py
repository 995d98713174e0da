"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most ``distance`` bits are linked, all of them. Fingerprints are cut into ``m``
groups of bits, and group ``i`` gets its own threshold ``t_i`` of at least -1 with ``sum(t_i) = distance - m + 1``;
then linked fingerprints differ in at most ``t_i`` bits within some group ``i``. For each group with
``t_i >= 0`` a fingerprint is stored under its value there and probed under all values within ``t_i`` bits.

* Correlated bits share a group, so that a group's values repeat what they have in common and the groups
  differ from each other. Correlations are counted over all distinct fingerprints.
* Thresholds come from a dynamic program over the groups that minimises probes plus estimated candidates,
  and the number of groups from comparing the programs' results. A group's pairs with equal values are
  counted exactly over all fingerprints; those within t bits are scaled from that by the bits' own
  disagreement rates.
* Candidates are compared on all 64 bits. ``connected`` does so in groups of bounded size (``meeting``), which
  give a spanning forest of their links, so that a dense group of n fingerprints gives a multiple of n rows; ``links``
  gives every link once, where they are asked for.

Equal fingerprints - copies of a text above all - are one class before any join, so that a group of copies
costs as much as a single document. Memory: per task a batch of texts; the driver holds 64 x 64 counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from orbweave.llm.components import components, contract, forest
from orbweave.llm.meeting import blocked, similar_sets, spanning
from orbweave.llm.store import Written, as_bytes, below_rate, fresh, ready, temporary

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: _BITS[k][b]: whether bit k of byte b is set
_BITS = np.array([[b >> k & 1 for b in range(256)] for k in range(8)], np.int64)
_LANE = np.arange(8, dtype=np.int64) * 256

#: What a probe (two rows shuffled and sorted) costs, in comparisons of a candidate.
PROBE_COST = 40.0
#: Fingerprints of one value that are compared with others at a time.
BLOCK = 4096


def fingerprint(text: bytes, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included; 0 for a text without words."""
    found = text.translate(_LOWER).split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)))
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles))
    ones = np.zeros((8, 256), np.int64)
    for a in range(0, len(h), 1 << 16):
        lanes = h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8) + _LANE
        ones += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    set_in = ones @ _BITS.T  # by byte and bit, lowest first
    return int.from_bytes(np.packbits((2 * set_in > len(h)).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, words) for x in as_bytes(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def together(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each two bits how many have both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.float64)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 4096)), pa.array(np.concatenate([[n], total.ravel()]).astype(np.int64))], names=["cell", "n"])

    ready(fps.sparkSession)
    got = {r["cell"]: r["n"] for r in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    return got.get(-1, 0), np.array([got.get(k, 0) for k in range(4096)], np.float64).reshape(64, 64)


def grouped(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in ``m`` groups of even size, each grown by the bit most correlated with it."""
    bits = len(both)
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    near = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = set(range(bits)), []
    for k in range(m):
        size = bits // m + (k < bits % m)
        group = [max(sorted(free), key=lambda b: near[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(free), key=lambda b: near[b, group].sum()))
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def mask(bits: list[int] | tuple[int, ...]) -> int:
    """These bits as a signed long."""
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >= 1 << 63 else x


def apart(disagree: np.ndarray, t: int) -> np.ndarray:
    """How many times as many pairs differ in 0 to ``t`` bits of a group as in none, from each bit's rate of disagreement."""
    odds = disagree / np.maximum(1 - disagree, 1e-9)
    ways = np.zeros(t + 1)
    ways[0] = 1
    for x in odds:
        ways[1:] += ways[:-1] * x
    return ways


def within(equal: float, disagree: np.ndarray, t: int) -> float:
    """Pairs within ``t`` bits of a group, from those equal in it and each bit's rate of disagreement."""
    return float(equal * apart(disagree, t).sum())


def allocate(costs: list[list[float]], total: int, least: int = -1) -> tuple[float, list[int]]:
    """Thresholds, one a group and at least ``least``, that sum to ``total`` at the least cost.

    ``costs[i][t]``: what threshold t costs in group i; -1, not probing it, costs nothing.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for k, row in enumerate(costs, 1):
        following: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t in range(least, len(row)):
                if s + t + least * (len(costs) - k) > total:
                    break
                one = (cost + (row[t] if t >= 0 else 0.0), [*chosen, t])
                if s + t not in following or one < following[s + t]:
                    following[s + t] = one
        best = following
    return best[total]


def scheme(fps: DataFrame, distance: int) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds for these distinct fingerprints."""
    n, both = together(fps)
    p = both.diagonal() / max(n, 1)
    disagree = 2 * p * (1 - p)
    options = {m: grouped(n, both, m) for m in range(max(2, distance - 1), distance + 2)}
    keyed = F.explode(F.array(*[F.struct(F.lit(100 * m + i).alias("g"), F.col("fp").bitwiseAND(F.lit(mask(g))).alias("v")) for m, groups in options.items() for i, g in enumerate(groups)])).alias("x")
    counted = fps.select(keyed).groupBy("x.g", "x.v").agg(F.count("*").cast("double").alias("c")).groupBy("g").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
    equal = {r["g"]: r["pairs"] for r in counted.collect()}
    found = []
    for m, groups in options.items():
        costs = [[PROBE_COST * n * sum(comb(len(g), j) for j in range(t + 1)) + within(equal.get(100 * m + i, 0.0), disagree[g], t) for t in range(distance + 1)] for i, g in enumerate(groups)]
        cost, t = allocate(costs, distance - m + 1)
        found.append((cost, m, groups, t))
    _, _, groups, t = min(found)
    return groups, t


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints ``fp`` that differ in 1 to ``distance`` bits, each once."""
    groups, thresholds = scheme(fps, distance)
    probed = [(i, mask(g), t) for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]

    def at(i: int, value: Column) -> Column:
        return F.struct(F.lit(i).alias("g"), value.alias("v"))

    own = fps.select("fp", F.explode(F.array(*[at(i, F.col("fp").bitwiseAND(F.lit(m))) for i, m, _ in probed])).alias("k")).select(F.col("fp").alias("a"), "k.g", "k.v")
    flips = [(i, m, mask(c)) for i, m, t in probed for r in range(t + 1) for c in combinations(groups[i], r)]
    if all(t == 0 for *_, t in probed):
        asked = own.select(F.col("a").alias("b"), "g", "v")
    else:
        # at most a few thousand flips, whatever the input: one literal array
        table = F.array(*[F.struct(F.lit(i).alias("g"), F.lit(m).alias("m"), F.lit(x).alias("x")) for i, m, x in flips])
        asked = fps.select("fp", F.explode(table).alias("k")).select(F.col("fp").alias("b"), "k.g", F.col("fp").bitwiseAND(F.col("k.m")).bitwiseXOR(F.col("k.x")).alias("v"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    earlier = F.lit(True)
    for k in range(1, len(probed)):
        missed = F.lit(True)
        for _, m, t in probed[:k]:
            missed = missed & (F.bit_count(differ.bitwiseAND(F.lit(m))) > t)
        earlier = F.when(F.col("x.g") == probed[k][0], missed).otherwise(earlier)
    x, y = own.alias("x"), asked.alias("y")
    return x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.v") == F.col("y.v")) & (F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance) & earlier).select("a", "b")


def connected(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(u, v): links of the distinct fingerprints ``fp`` that connect just what ``links`` does, a multiple of their number.

    A group of fingerprints with equal values meets as a whole, or block by block if it is large.
    """
    groups, thresholds = scheme(fps, distance)
    flips = [(i, mask(g), mask(c)) for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)) for r in range(t + 1) for c in combinations(g, r)]
    # at most a few thousand flips, whatever the input: one literal array; the fingerprint's own value has none
    table = F.array(*[F.struct(F.lit(i).alias("g"), F.lit(m).alias("m"), F.lit(x).alias("x")) for i, m, x in flips])
    rows = fps.select("fp", F.explode(table).alias("k")).select("fp", "k.g", F.col("fp").bitwiseAND(F.col("k.m")).bitwiseXOR(F.col("k.x")).alias("v"), (F.col("k.x") == 0).cast("long").alias("own"))
    size = F.count("*")
    totals = rows.groupBy("g", "v").agg(size.alias("n"), F.sum("own").alias("owned")).filter("n > 1 AND owned > 0").select("g", "v", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return (np.bitwise_count((x[..., :, None, 0] ^ y[..., None, :, 0]).view(np.uint64)) <= distance) & ((x[..., :, None, 1] | y[..., None, :, 1]) > 0)

        def flush(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            begin = np.flatnonzero(np.append(True, (rows[1:, :4] != rows[:-1, :4]).any(1)))
            size = np.diff(np.append(begin, len(rows)))
            x = rows[:, 5:7]
            for n in np.unique(size[size > 1]):
                at = begin[size == n]
                if n <= 64:
                    step = max(1, (1 << 20) // (n * n))
                    for a in range(0, len(at), step):
                        part = x[at[a : a + step, None] + np.arange(n)]
                        g, i, j = np.nonzero(near(part, part) & np.tri(n, k=-1, dtype=bool))
                        # blocks of a group that meet hold pairs inside a block too; to find those again does no harm
                        yield part[g, i, 0], part[g, j, 0]
                    continue
                for b in at:
                    group = rows[b : b + n]
                    m = 0 if group[0, 2] == group[0, 3] else int(np.searchsorted(group[:, 4], group[-1, 4]))
                    top, side, label = (group[:m] if m else group), group[m:], np.arange(n)
                    for a in range(0, len(top), 256):
                        label = spanning(near(top[a : a + 256, 5:7], side[:, 5:7]), label, a, m)
                    yield group[:, 5], group[label, 5]

        def batch(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for u, v in pairs:
                u, v = forest(u, v)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        held = np.zeros((0, 7), np.int64)
        for b in batches:
            rows = np.concatenate([held, np.stack([b.column(c).to_numpy() for c in range(7)], 1)])
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(1)) if len(rows) else np.zeros(0, np.int64)
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole >= 1 << 15 or (whole and len(rows) - whole > BLOCK):
                yield from batch(flush(rows[:whole]))
                rows = rows[whole:]
            held = rows
        if len(held):
            yield from batch(flush(held))

    ready(fps.sparkSession)
    placed = blocked(rows, totals, ["g", "v"], F.col("fp"), F.lit(0), F.col("blocks"), F.col("blocks"))
    met = placed.select(F.col("g").cast("long").alias("g"), "v", F.col("pa").cast("long").alias("pa"), F.col("pb").cast("long").alias("pb"), F.col("block").cast("long").alias("block"), "fp", "own")
    order = ["g", "v", "pa", "pb"]
    return met.repartition(*order).sortWithinPartitions(*order, "block").mapInArrow(meet, "u long, v long")


def components_of(fps: DataFrame, distance: int) -> DataFrame:
    """(fp, component_id): each distinct fingerprint of ``fps`` (doc_id, fp) and the smallest doc_id it is linked to."""
    classes = Written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes").df
    linked = Written(contract(connected(classes.select("fp"), distance)), "links").df
    joined = components(linked)
    of = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    return Written(of.join(least, "component").select("fp", "component_id"), "named").df


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id among the documents reachable over links. Texts are read whole, by
    bytes; a null or empty text has fingerprint zero and is linked like any other; repeated rows are linked
    as copies; rows with a null doc_id are kept but never name a component, unless they have no other member
    (then it is null). An empty table gives an empty result.
    """
    fps = Written(fingerprints(docs, words), "fingerprints").df
    return fps.join(components_of(fps, distance), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Signs in a long fingerprint: a power of 4.
SIGNS = 4096
#: Long fingerprints, about, that groups and thresholds are planned from, and groups that are grown from the same signs.
SAMPLE, POOL = 4096, 4
#: Members of a value that are compared by 128 signs at once. Where there are more, their sets are, block by block.
TOGETHER = 16
#: Texts of at most so many shingles find all that is similar to them by the shingles themselves. Signs of sums of a few
#: hashes are often those of zero, and they depend on each other.
SHORT = 64


def shingles(text: bytes, words: int) -> np.ndarray:
    """Hashes of the text's set of shingles, in order."""
    found = text.translate(_LOWER).split()
    distinct = {b" ".join(found)} if len(found) < words else set(map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)))
    return np.unique(np.fromiter(map(xxh64_intdigest, distinct, repeat(42)), np.uint64, len(distinct)))


def long_fingerprint(h: np.ndarray) -> tuple[int, bytes]:
    """A hash of a set of shingles, and SIGNS signs of random projections of that set.

    Shingles are hashed to signed coordinates, and these are mixed by a Hadamard transform: each sign is that
    of a sum of random signs over all shingles, as a SimHash bit is, at a cost that doesn't grow with SIGNS.
    """
    at, sign = (h % np.uint64(SIGNS)).astype(np.int64), 1.0 - 2.0 * ((h >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
    v = np.bincount(at, sign, SIGNS).reshape(64, 64)
    mixed = _HADAMARD @ v @ _HADAMARD
    return int(np.int64(xxh64_intdigest(h.tobytes(), 5) - (1 << 63))), np.packbits(mixed.ravel() > 0).tobytes()


def _hadamard() -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < 64:
        h = np.block([[h, h], [h, -h]])
    return h


_HADAMARD = _hadamard()


def number(width: int, similarity: float, recall: float) -> int:
    """How many groups of so many signs, in one of which a pair of this similarity agrees with this chance."""
    return int(np.ceil(np.log(1 - recall) / np.log1p(-((1 - apart_at(similarity)) ** width))))


def apart_at(similarity: float) -> float:
    """The share of signs that differ at this similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def partitions(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """Largest width of groups of signs and their number, for long fingerprints of ``n`` texts and thresholds of 0.

    Wide enough that unrelated texts share about one value a group, and so many that a pair of this
    similarity agrees in one of them with this chance. Where the signs don't last for that many, the width stays
    at the largest that they last for: unrelated texts then share values, which costs time, not pairs.
    """
    fit = [w for w in range(10, 33) if number(w, similarity, recall) * w <= SIGNS - 128]
    if not fit:
        raise ValueError(f"{SIGNS} signs can't find pairs at a similarity of {similarity} with a chance of {recall}")
    width = min(max(fit), max(10, int(np.ceil(np.log2(max(n, 2))))))
    return width, number(width, similarity, recall)


def pooled(bits: np.ndarray, width: int, m: int) -> list[list[int]]:
    """``m`` groups of ``width`` signs that are correlated in these fingerprints (rows), POOL groups from the same signs."""
    groups = []
    for a in range(0, m, POOL):
        some = min(POOL, m - a)
        x = bits[:, a * width : (a + some) * width].astype(np.float32)
        groups += [[a * width + b for b in g] for g in grouped(len(x), (x.T @ x).astype(np.float64), some)]
    return groups


def meetings(equal: float, disagree: np.ndarray, t: int) -> float:
    """How often two fingerprints meet in a value of a group that both are put under all values within ``t`` bits of."""
    width = len(disagree)

    def shared(d: int) -> int:  # values within t bits of both of two that differ in d
        return sum(comb(d, x) * comb(width - d, y) for x in range(d + 1) for y in range(width - d + 1) if max(x, d - x) + y <= t)

    return float(equal * sum(n * shared(d) for d, n in enumerate(apart(disagree, 2 * t))))


def arranged(bits: np.ndarray, n: int, similarity: float, recall: float) -> list[tuple[list[int], int]]:
    """Groups of signs and their thresholds, for ``n`` long fingerprints of which ``bits`` (rows) are a sample.

    As for short ones: correlated signs share a group, the number ``m`` of groups comes from comparing the results of
    a dynamic program, and its thresholds sum to ``distance - m + 1``. The distance is one less than the groups
    that find a pair of this similarity with the chance ``recall`` at thresholds of 0. What differs in no more
    of the grouped signs is found for certain, and every m has to keep that chance for a pair at the similarity. Such a
    pair is mostly further apart than that, so that each group counts and none is left out (-1). The sample is
    for costs: which pairs share a value is counted in it, and scaled to n.
    """
    widest, _ = partitions(n, similarity, recall)
    p = bits.mean(0)
    found = []
    # narrower groups are fewer, and as long as unrelated texts share a value with four others at most, still well apart
    for width in range(min(widest, max(10, int(np.ceil(np.log2(n / 4))))), widest + 1):
        parts = number(width, similarity, recall)
        groups = pooled(bits, width, parts)
        disagree = [2 * p[g] * (1 - p[g]) for g in groups]
        # of a pair at the similarity, signs differ more often where they do so more often in all pairs
        scale = apart_at(similarity) / max(float(np.mean(disagree)), 1e-9)
        rates = [np.minimum(x * scale, 0.5) for x in disagree]
        equal = [n + n * (n - 1) * same(bits[:, g]) for g in groups]
        costs = [[PROBE_COST * n * sum(comb(width, j) for j in range(t + 1)) + meetings(e, x, t) for t in range(3)] for e, x in zip(equal, disagree, strict=True)]
        for m in range(max(1, parts - 2), parts + 1):
            cost, t = allocate(costs[:m], parts - m, 0)
            missed = np.prod([1 - within(float(np.prod(1 - r)), r, x) for r, x in zip(rates, t, strict=False)])
            if m == parts or 1 - missed >= recall:
                found.append((cost, width, m, list(zip(groups, t, strict=False))))
    return min(found)[3]


def same(bits: np.ndarray) -> float:
    """The share of all pairs of rows that are equal."""
    values = np.sort(bits @ (1 << np.arange(bits.shape[1], dtype=np.int64)))
    c = np.diff(np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])))
    return float((c * (c - 1.0)).sum() / max(1, len(bits) * (len(bits) - 1)))


def short_links(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v): links that connect all texts (k, z, n) of SHORT shingles, or little more, to what is similar to them.

    Of n shingles, the rarest first, two similar texts share one of the first ``n - ceil(similarity * n) + 1`` of each.
    Those that share one are compared exactly (``similar_sets``).
    """
    ready(texts.sparkSession)
    few = texts.filter(F.col("n") <= int(SHORT / similarity)).select("k", "z").mapInArrow(as_sets(words, listed=True), "k long, h binary, t array<long>")
    sets = Written(few, "short").df
    each = sets.select("k", F.explode("t").alias("t"))
    rare = each.groupBy("t").agg(F.count("*").alias("c")).filter("c > 1")
    of = each.join(rare, "t").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("common"))  # at most 80 each
    n = F.size("t")
    left = n - F.ceil(n * F.lit(similarity) - 1e-9).cast("int") + 1 - (n - F.size("common"))
    asked = of.join(sets, "k").filter(left > 0).select(F.explode(F.slice("common", F.lit(1), left)).alias("x"), "k").select(F.col("x.t").alias("value"), "k", F.col("k").alias("label"))
    return similar_sets(Written(asked, "asked").df, sets.select("k", "h"), similarity)


def as_sets(words: int, listed: bool = False):
    """For mapInArrow over (k, z), z a compressed text: k and the set of shingles as bytes, and ``listed`` too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            sets = [shingles(unpack.decompress(x), words).view(np.int64) for x in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.list_(pa.int64()))], names=["k", "h", "t"]) if listed else pa.RecordBatch.from_arrays(columns, names=["k", "h"])

    return run


def similar(classes: DataFrame, texts: DataFrame, words: int, similarity: float, recall: float) -> DataFrame:
    """(u, v): verified links between ``classes`` (k, signs, n), enough of them to connect each group.

    ``texts`` (k, z, n) has the compressed text of each class, ``n`` is its number of shingles.

    By the generalised pigeonhole principle: correlated signs of the long fingerprints are in groups, each with its own
    threshold (``arranged``), and pairs within the threshold of a group are candidates: all that differ in fewer
    of the grouped signs than there would be groups with threshold 0, and pairs at the similarity with the chance
    ``recall``. (A certain find at this distance, a seventh of all signs, would probe a large share of all pairs.)
    Groups are probed in two passes: what a few of them link is joined first, and the rest then looks only for pairs
    that aren't joined yet, so that a group of n copies gives some multiple of n links and its borderline members are
    still asked for everywhere.
    """
    links = short_links(texts, words, similarity)
    n, of_signs = classes.agg(F.count("*"), F.count_if(F.col("n") > SHORT)).first()
    if not of_signs:
        return links
    classes = classes.filter(F.col("n") > SHORT)
    sample = classes.filter(below_rate(F.col("k"), 37, SAMPLE / of_signs)).select("signs").toArrow().column(0).to_pylist()
    groups = list(enumerate(arranged(np.unpackbits(np.frombuffer(b"".join(sample), np.uint8).reshape(len(sample), -1), axis=1), n, similarity, recall)))
    first = -(-len(groups) // 6)
    labelled = classes.select("k", "signs", F.col("k").alias("label"))
    links = links.unionAll(probed(labelled, texts, words, similarity, groups[:first]))
    if first == len(groups):
        return links
    joined = components(links, rounds=1).groupBy(F.col("node").alias("k")).agg(F.min("component").alias("component"))
    labelled = classes.join(joined, "k", "left").select("k", "signs", F.coalesce("component", "k").alias("label"))
    return links.unionAll(probed(labelled, texts, words, similarity, groups[first:]))


def probed(classes: DataFrame, texts: DataFrame, words: int, similarity: float, groups: list[tuple[int, tuple[list[int], int]]]) -> DataFrame:
    """(u, v): verified links between ``classes`` (k, signs, label) of different labels that are within the threshold of one of these groups.

    ``groups``: a number, and the signs and the threshold that go with it; all have the same width.

    The few members of a value are compared by 128 signs kept for that; all signs then leave out what is far from
    similar (by four and five standard errors), and what is left is verified on the sets of shingles. Values that
    more than TOGETHER share, or that lie in two tasks, go to ``similar_sets``: all their members are compared.
    """
    with temporary(classes.sparkSession) as keep:
        keep.append(Written(_probed(classes, texts, words, similarity, groups), "links"))
    return keep[0].df


def _probed(classes: DataFrame, texts: DataFrame, words: int, similarity: float, groups: list[tuple[int, tuple[list[int], int]]]) -> DataFrame:
    differ = apart_at(similarity)
    most = int(SIGNS * differ + 5 * np.sqrt(SIGNS * differ * (1 - differ)))
    loose = int(128 * differ + 4 * np.sqrt(128 * differ * (1 - differ)))
    order = np.array([g for _, (g, _) in groups])
    width = order.shape[1]
    # each group's own value and those within its threshold
    which, key, flip = np.array([(a, i << 32, mask(c)) for a, (i, (_, t)) in enumerate(groups) for r in range(t + 1) for c in combinations(range(width), r)], np.int64).T

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(width, dtype=np.int64)
        for b in batches:
            k, label = b.column(0).to_numpy(), b.column(2).to_numpy()
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(k), -1)
            aux = np.ascontiguousarray(raw[:, -16:]).view("<i8")
            own = np.unpackbits(raw, axis=1)[:, order] @ power
            value = own[:, which] ^ flip | key
            yield pa.RecordBatch.from_arrays([pa.array(value.ravel()), *(pa.array(np.repeat(x, len(which))) for x in (k, aux[:, 0], aux[:, 1], label))], names=["value", "k", "aux", "aux2", "label"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = crowded = None  # the task's first value, and one that is known to have many members

        def members(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, c])) for c in (1, 4, 0)], names=["u", "v", "value"])

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            begin = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            size = np.diff(np.append(begin, len(rows)))
            apart = (size > TOGETHER) | (rows[begin, 0] == first) | (rows[begin, 0] == crowded)
            yield from members(rows[np.repeat(apart, size)])
            found = []
            for n in np.unique(size[~apart & (size > 1)]):
                part = rows[begin[(size == n) & ~apart][:, None] + np.arange(n)]
                d = sum(np.bitwise_count((part[:, :, None, c] ^ part[:, None, :, c]).view(np.uint64)).astype(np.int16) for c in (2, 3))
                g, i, j = np.nonzero((d <= loose) & (part[:, :, None, 4] != part[:, None, :, 4]) & np.tri(n, k=-1, dtype=bool))
                x, y = part[g, i, 1], part[g, j, 1]
                found.append(np.stack([np.maximum(x, y), np.minimum(x, y)], 1))
            both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.nulls(len(both), pa.int64())], names=["u", "v", "value"])

        held = np.zeros((0, 5), np.int64)
        for b in batches:
            rows = np.concatenate([held, np.stack([b.column(c).to_numpy() for c in ("value", "k", "aux", "aux2", "label")], 1)])
            if not len(rows):
                continue
            first = rows[0, 0] if first is None else first
            whole = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if whole >= 1 << 14 or len(rows) - whole > TOGETHER:
                if whole:
                    yield from flush(rows[:whole])
                rows = rows[whole:]
                if len(rows) > TOGETHER:  # of a value that goes on; what follows of it is known to be crowded
                    crowded = rows[0, 0]
                    yield from members(rows)
                    rows = rows[:0]
            held = rows
        if len(held):
            whole = int(np.searchsorted(held[:, 0], held[-1, 0]))
            if whole:
                yield from flush(held[:whole])
            yield from members(held[whole:])

    ready(classes.sparkSession)
    rows = classes.select("k", "signs", "label").mapInArrow(emit, "value long, k long, aux long, aux2 long, label long")
    spread = F.xxhash64("value", "k")
    found = Written(rows.repartitionByRange(F.col("value"), spread).sortWithinPartitions(F.col("value"), spread).mapInArrow(meet, "u long, v long, value long"), "candidates").df
    signs = classes.select("k", "signs")
    asked = found.filter("value IS NULL").select("u", "v").distinct()
    both = asked.join(signs.withColumnsRenamed({"k": "u", "signs": "su"}), "u").join(signs.withColumnsRenamed({"k": "v", "signs": "sv"}), "v")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("su", "sv"))
            ok = pa.array(np.bitwise_count(x ^ y).sum(1) <= most)
            yield pa.RecordBatch.from_arrays([b.column("u").filter(ok), b.column("v").filter(ok)], names=["u", "v"])

    near = Written(both.mapInArrow(sift, "u long, v long"), "near").df
    of_many = found.filter("value IS NOT NULL").select("value", F.col("u").alias("k"), F.col("v").alias("label"))
    kinds = of_many.groupBy("value").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("value")
    crowd = Written(of_many.join(kinds, "value", "left_semi"), "crowd").df
    nodes = near.select(F.col("u").alias("k")).unionAll(near.select(F.col("v").alias("k"))).unionAll(crowd.select("k")).distinct()
    sets = Written(texts.join(nodes, "k", "left_semi").select("k", "z").mapInArrow(as_sets(words), "k long, h binary"), "sets").df
    pairs = near.join(sets.withColumnsRenamed({"k": "u", "h": "hu"}), "u").join(sets.withColumnsRenamed({"k": "v", "h": "hv"}), "v")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("hu").to_pylist(), b.column("hv").to_pylist(), strict=True):
                h = np.sort(np.frombuffer(x + y, np.uint64))
                shared = int((h[1:] == h[:-1]).sum())
                ok.append(shared >= similarity * (len(h) - shared) - 1e-9)
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u").filter(ok), b.column("v").filter(ok)], names=["u", "v"])

    verified = pairs.mapInArrow(verify, "u long, v long")
    return verified if crowd.isEmpty() else verified.unionAll(similar_sets(crowd, sets, similarity))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """One row of each group of near duplicates in ``docs``, with all its columns: one with the smallest doc_id.

    Near duplicates have shingle sets of this Jaccard similarity or more, or are linked by such: every link is
    compared exactly, and a pair at the similarity is looked at with the chance ``recall``, or
    always if a text has at most SHORT shingles. Texts without words, null and empty ones, are one group. A null doc_id
    counts as the largest. Of rows that repeat id and text, one stays: the first by all columns. Columns of any name are
    kept as they are. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(3)
        for b in batches:
            sets = [shingles(x, words) for x in as_bytes(b.column(2))]
            found = [long_fingerprint(h) for h in sets]
            packed = pa.array([packer.compress(x) for x in as_bytes(b.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary()), pa.array([len(h) for h in sets], pa.int64()), packed], names=["id", "th", "k", "signs", "n", "z"])

    ready(docs.sparkSession)
    text = F.col("text").cast("string")
    key, of_text = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(text)
    with temporary(docs.sparkSession) as keep:
        rows = Written(docs.select(key.alias("id"), of_text.alias("th"), text.alias("text")).mapInArrow(run, "id long, th long, k long, signs binary, n long, z binary"), "fingerprinted").df
        classes = Written(rows.groupBy("k").agg(F.min("id").alias("id")), "classes").df
        # of each class one row; rows that repeat the id and the text's class are alike in what is used of them
        reps = Written(rows.drop("th").join(classes, ["k", "id"], "left_semi").dropDuplicates(["k"]), "representatives")
        joined = components(similar(reps.df.select("k", "signs", "n"), reps.df.select("k", "z", "n"), words, similarity, recall))
        reps.drop()
        of = classes.join(joined.withColumnRenamed("node", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
        best = of.groupBy("component").agg(F.min(F.struct("id", "k")).alias("best")).select("best.id", "best.k")
        chosen = Written(rows.select("id", "k", "th").join(best, ["id", "k"]).groupBy("id", "k").agg(F.min("th").alias("th")).select("id", "th"), "chosen")
        keep.append(chosen)
        repeated = not rows.join(chosen.df, ["id", "th"], "left_semi").groupBy("id", "th").count().filter("count > 1").isEmpty()
    id_, th, all_ = fresh(docs, "id", "th", "all")
    left = docs.withColumns({id_: key, th: of_text}).join(chosen.df.withColumnsRenamed({"id": id_, "th": th}), [id_, th], "left_semi")
    if repeated:
        left = left.withColumn(all_, F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}))
        least = left.groupBy(id_, th).agg(F.min(all_).alias(all_))
        left = left.join(least, [id_, th, all_], "left_semi").dropDuplicates([id_, th])
    return left.select(*docs.columns)
