"""Exact removal of byte strings of ``LENGTH`` or more that occur more than once in a corpus.

A byte goes if it lies in a window of LENGTH bytes that also starts at another place, in the same text or
another; all occurrences go. Windows are compared where they are needed only:

1. *Anchors.* Of the K-byte strings in a window, the one with the least hash (the rightmost, if several) is
   its anchor. Equal windows have equal anchors at equal offsets, so only windows with the same anchor need
   to meet. Windows that follow each other and share an anchor are one *run*.
2. *Runs.* A run is known by its anchor's hash ``h`` and a hash ``c`` of all its bytes. If no other run has
   the same ``h``, none of its windows repeats. If another has the same ``c`` too, all of them repeat.
3. *Edges.* What is left - runs whose anchor repeats but whose bytes differ, at the ends of a repeated
   passage - is compared window by window, with one run of each ``c`` as its partners. Bytes of these runs
   alone are shuffled, by ``h``. Runs of an anchor with very many different ones (``HOT``) don't go to one
   task: each is cut in ``PARTS``, and what the windows of a part have in common, which is longer than the
   anchor, is their anchor from then on (``settled``).

Equal texts are one class: their members are removed whole (from LENGTH bytes on), and one of them stands
for the class when it is compared with others. Counts and statistics cover all texts. Bytes are compared by
128 bits of hashes (anchor and content, or anchor and window).

This stands in for a suffix array by external induced sorting, which takes a tuple of position, rank and
common prefix through a priority queue for every byte; the README says why, with figures. ``matcher`` is what
finds equal windows among the edges that have come together: by hashes, or by that suffix array
(``induced.matcher``), with the same result.

Windows can also be of words (``unit`` is ``np.uint64``, a hash of each word; blanks between words don't count): then
lengths, places and anchors are in words, and the rest is the same. ``without_repeats`` can remove both kinds at once,
each found in the texts as they were.

Memory: a batch of texts, and of the edges about ``CHUNK`` bytes at a time.

Edge cases: null texts count as empty; texts under LENGTH bytes keep everything but can't hold a match;
repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

from orbweave.llm.store import Written, as_bytes, fresh, ready, temporary

LENGTH = 400
K = 128
#: Words in the anchor of a window of words.
WORDS_K = 16
#: Runs of an anchor that has more different ones than this are cut before they are compared, in so many parts.
HOT, PARTS = 256, 4
CHUNK = 4 << 20
BLOCK = 1 << 18

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_POS = np.uint64((1 << 20) - 1)
_EMPTY = hashlib.sha256(b"").hexdigest()
_RUN = pa.struct([("h", pa.int64()), ("c", pa.int64()), ("i", pa.int32()), ("j", pa.int32())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def key_of(text: bytes) -> tuple[int, int]:
    x = xxh3_128_intdigest(text)
    return _signed(x >> 64), _signed(x & ((1 << 64) - 1))


def units(text: bytes, unit: type) -> np.ndarray:
    """What windows are made of: the bytes of a text, or hashes of its words."""
    if unit is np.uint8:
        return np.frombuffer(text, np.uint8)
    return np.array([xxh3_64_intdigest(x) for x in text.split()], np.uint64)


def strings(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` units (a power of two, 8 at least) from each position on."""
    g = data.astype(np.uint64)
    s = 1
    if data.dtype == np.uint8:
        for s in (1, 2, 4):
            g = g[:-s] | (g[s:] << np.uint64(8 * s))
        s = 8
    while s < size:
        x, y = g * _M1, g[s:] * _M2
        x ^= x >> np.uint64(29)
        y ^= y >> np.uint64(31)
        g = (x[:-s] + y) * _M1
        g ^= g >> np.uint64(32)
        s *= 2
    return g


def windows(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` units from each position on."""
    size = 8
    while 2 * size <= length:
        size *= 2
    g = strings(data, size)
    x, y = g[: len(data) - length + 1] * _M2, g[length - size :] * _M1
    x ^= x >> np.uint64(30)
    out = (x + y) * _M2
    return out ^ (out >> np.uint64(31))


def anchors(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window: where its anchor is, and the anchor's hash."""
    w = length - k + 1
    at, of = [], []
    for a in range(0, len(data) - length + 1, BLOCK):
        h = strings(data[a : a + BLOCK + length - 1], k)
        n = len(h) - w + 1
        ranked = (h & ~_POS) | (_POS - np.arange(len(h), dtype=np.uint64))
        full = np.full(-(-len(h) // w) * w, ~np.uint64(0))
        full[: len(h)] = ranked
        full = full.reshape(-1, w)
        ahead = np.minimum.accumulate(full, 1).ravel()
        behind = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
        pos = (_POS - (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & _POS)).astype(np.int64)
        at.append(a + pos)
        of.append(h[pos])
    return np.concatenate(at), np.concatenate(of)


def runs(data: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """h, c, and first and last window of each run of a text's units."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4
    at, h = anchors(data, length, k)
    i = np.flatnonzero(np.diff(at, prepend=-1))
    j = np.append(i[1:], len(at)) - 1
    text, size = data.tobytes(), data.itemsize
    c = np.array([xxh3_64_intdigest(text[a * size : (b + length) * size]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.uint64)
    return h[i].view(np.int64), c.view(np.int64), i, j


def scan(docs: DataFrame, length: int, k: int, unit: type = np.uint8) -> DataFrame:
    """(doc_id, k1, k2, n, sha, runs) of each row; ``n``: its units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            data = [units(x, unit) for x in texts]
            parts = [runs(x, length, k) for x in data]
            offsets = np.cumsum([0, *(len(p[0]) for p in parts)]).astype(np.int32)
            h, c, i, j = (np.concatenate([p[x] for p in parts]) if parts else np.zeros(0, np.int64) for x in range(4))
            structs = pa.StructArray.from_arrays([pa.array(h), pa.array(c), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], fields=list(_RUN))
            keys = [key_of(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x for x, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.int64()), pa.array([len(x) for x in data], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), pa.ListArray.from_arrays(pa.array(offsets), structs)],
                names=["doc_id", "k1", "k2", "n", "sha", "runs"],
            )

    ready(docs.sparkSession)
    return _plain(docs).mapInArrow(run, "doc_id long, k1 long, k2 long, n long, sha string, runs array<struct<h: long, c: long, i: int, j: int>>")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col("text").cast("string").alias("text"))


def compressed(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, k1, k2, z): texts of ``length`` bytes or more by their class, compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(1)
        for b in batches:
            rows = [(d, *key_of(x), packer.compress(x)) for d, x in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True) if len(x) >= length]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "k1", "k2", "z"])

    ready(docs.sparkSession)
    return _plain(docs).mapInArrow(run, "doc_id long, k1 long, k2 long, z binary")


def hashed_matcher(parts: list[bytes], length: int, unit: type = np.uint8) -> list[np.ndarray]:
    """Which windows of these strings occur more than once among all of theirs, by their hashes."""
    data = [np.frombuffer(x, unit) for x in parts]
    size = [len(x) - length + 1 for x in data]
    w = np.concatenate([windows(x, length) for x in data])
    order = np.argsort(w)
    same = w[order[1:]] == w[order[:-1]]
    hit = np.zeros(len(w), bool)
    hit[order[1:]] = same
    hit[order[:-1]] |= same
    return np.split(hit, np.cumsum(size)[:-1])


def _ranges(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of true values."""
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def matched(edges: DataFrame, length: int, matcher: Callable[[list[bytes], int], list[np.ndarray]]) -> DataFrame:
    """(k1, k2, i, j): window ranges of the edge runs (h, k1, k2, i, bytes) that repeat within their anchor's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = []
            for (_, k1, k2, i, _), hit in zip(held, matcher([x[4] for x in held], length), strict=True):
                out += [(k1, k2, i + a, i + b) for a, b in zip(*(x.tolist() for x in _ranges(hit)), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["k1", "k2", "i", "j"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("h", "k1", "k2", "i", "bytes")), strict=True):
                if size > CHUNK and row[0] != held[-1][0]:
                    yield from flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from flush()

    return edges.repartition("h").sortWithinPartitions("h").mapInArrow(run, "k1 long, k2 long, i int, j int")


def parted(hot: DataFrame, length: int, k: int, unit: type = np.uint8) -> DataFrame:
    """Each run (k1, k2, i, bytes, q, lo, hi) of anchors with many, by quarters of the offsets [lo, hi] it was kept for.

    ``q``: how far the anchor is from the first window, -1 if not known yet. All windows of one part have more
    bytes in common than the anchor, and the hash of these is the new ``h``: windows that are equal still meet.
    """
    size = np.dtype(unit).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k1, k2, i, text, q, lo, hi in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "i", "bytes", "q", "lo", "hi")), strict=True):
                n = len(text) // size - length + 1
                if q < 0:
                    q = int(anchors(np.frombuffer(text, unit)[:length], length, k)[0][0])
                cuts = [lo + (hi + 1 - lo) * p // PARTS for p in range(PARTS + 1)]
                for x, y in zip(cuts, (c - 1 for c in cuts[1:]), strict=False):
                    t1, t2 = q - min(y, q), q - max(x, q - n + 1)
                    if x <= y and t1 <= t2:
                        part = text[t1 * size : (t2 + length) * size]
                        out.append((_signed(xxh3_64_intdigest(text[(q - x) * size : (q - y + length) * size], x << 16 | y)), _signed(xxh3_64_intdigest(part)), k1, k2, i + t1, part, q - t1, x, y))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 4 + (pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["h", "c", "k1", "k2", "i", "bytes", "q", "lo", "hi"])

    return hot.mapInArrow(run, "h long, c long, k1 long, k2 long, i int, bytes binary, q int, lo int, hi int").withColumn("o", F.xxhash64("k1", "k2", "i"))


def marks(run: DataFrame) -> DataFrame:
    """The runs (h, c, o and others) whose ``h`` repeats, with ``kinds`` (different runs of it), ``whole`` (all its windows repeat) and ``compare`` (to be held against the others)."""
    by_c = Written(run.groupBy("h", "c").agg(F.count("*").alias("nc"), F.min("o").alias("first")), "contents").df
    by_h = by_c.groupBy("h").agg(F.sum("nc").alias("nh"), F.count("*").alias("kinds")).filter("nh > 1")
    stats = by_c.join(by_h, "h").select("h", "c", "nc", "first", "kinds")
    return run.join(stats, ["h", "c"]).withColumn("whole", F.col("nc") > 1).withColumn("compare", (F.col("kinds") > 1) & (F.col("o") == F.col("first"))).drop("nc", "first", "o")


def settled(edges: DataFrame, length: int, k: int, matcher: Callable[[list[bytes], int], list[np.ndarray]], unit: type = np.uint8) -> DataFrame:
    """(k1, k2, i, j): window ranges of the edge runs (h, k1, k2, i, bytes, kinds) that repeat.

    Runs of anchors with more than HOT of them are cut, and what is then common to the windows of a part
    becomes their anchor, until each has few runs or all its runs are equal; at the latest a part is one window.
    """
    few, whole = [], []
    pending = edges.select("h", "k1", "k2", "i", "bytes", "kinds", F.lit(-1).alias("q"), F.lit(0).alias("lo"), F.lit(length - k).alias("hi"))
    while True:
        few.append(pending.filter(F.col("kinds") <= HOT).select("h", "k1", "k2", "i", "bytes"))
        hot = pending.filter(F.col("kinds") > HOT)
        if hot.isEmpty():
            return reduce(DataFrame.unionAll, whole, matched(reduce(DataFrame.unionAll, few), length, matcher))
        marked = Written(marks(Written(parted(hot, length, k, unit), "parts").df), "marked").df
        whole.append(marked.filter("whole").select("k1", "k2", "i", (F.col("i") + F.length("bytes") / np.dtype(unit).itemsize - length).cast("int").alias("j")))
        pending = marked.filter("compare").select("h", "k1", "k2", "i", "bytes", "kinds", "q", "lo", "hi")


def covered(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """The maximal byte spans [a, b) that windows from ``i`` to ``j`` cover."""
    spans: list[tuple[int, int]] = []
    for i, j in sorted((r["i"], r["j"]) for r in ranges):
        if spans and i <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], j + length))
        else:
            spans.append((i, j + length))
    return spans


class Repeats:
    """What repeats in ``docs`` (doc_id, text).

    ``scanned``: doc_id, k1, k2 (the text's class), n, sha of each row. ``classes``: k1, k2, copies.
    ``ranges``: k1, k2, ranges - of each class with one member that has any, the window ranges that repeat.
    """

    def __init__(self, docs: DataFrame, length: int = LENGTH, k: int = K, matcher: Callable = hashed_matcher, keep_scan: bool = True, unit: type = np.uint8):
        with temporary(docs.sparkSession) as keep:
            self._find(docs, length, k, matcher, keep_scan, unit, keep)

    def _find(self, docs: DataFrame, length: int, k: int, matcher: Callable, keep_scan: bool, unit: type, keep: list[Written]) -> None:
        size = np.dtype(unit).itemsize
        scanned = Written(scan(docs, length, k, unit), "scan")
        all_ = scanned.df
        self.scanned = all_.drop("runs")
        classes = Written(all_.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep")), "classes")
        self.classes = classes.df
        ones = all_.filter(F.col("n") >= length).join(self.classes.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2", "doc_id"], "left_semi")
        run = Written(ones.select("doc_id", "k1", "k2", F.explode("runs").alias("r")).select("doc_id", "k1", "k2", "r.*", F.xxhash64("k1", "k2", "r.i").alias("o")), "runs")
        keep += [classes] + [scanned] * keep_scan
        if not keep_scan:
            scanned.drop()
        marked = Written(marks(run.df).select("doc_id", "k1", "k2", "h", "i", "j", "kinds", "whole", "compare"), "marked").df
        run.drop()
        asked = marked.filter("compare").groupBy("doc_id", "k1", "k2").agg(F.collect_list(F.struct("h", "i", "j", "kinds")).alias("asked"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = zstandard.ZstdDecompressor()
            for b in batches:
                for k1, k2, z, rows in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "z", "asked")), strict=True):
                    text = units(unpack.decompress(z), unit).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["h"] for r in rows], pa.int64()), pa.array([k1] * len(rows), pa.int64()), pa.array([k2] * len(rows), pa.int64()), pa.array([r["i"] for r in rows], pa.int32()), pa.array([text[r["i"] * size : (r["j"] + length) * size] for r in rows], pa.binary()), pa.array([r["kinds"] for r in rows], pa.int64())],
                        names=["h", "k1", "k2", "i", "bytes", "kinds"],
                    )

        edges = Written(compressed(docs, length).join(asked.hint("merge"), ["doc_id", "k1", "k2"]).mapInArrow(cut, "h long, k1 long, k2 long, i int, bytes binary, kinds long"), "edges").df
        found = settled(edges, length, k, matcher, unit).unionAll(marked.filter("whole").select("k1", "k2", "i", "j"))
        single = found.join(self.classes.filter("copies = 1").select("k1", "k2"), ["k1", "k2"], "left_semi")
        ranges = Written(single.groupBy("k1", "k2").agg(F.collect_list(F.struct("i", "j")).alias("ranges")), "ranges")
        keep.append(ranges)
        self.ranges = ranges.df


def digest(docs: DataFrame, length: int = LENGTH, k: int = K, matcher: Callable = hashed_matcher) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs`` (doc_id, text)."""
    repeats = Repeats(docs, length, k, matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for k1, k2, z, ranges in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "z", "ranges")), strict=True):
                text, spans = unpack.decompress(z), covered(ranges, length)
                rows.append((k1, k2, sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept(text, spans)).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "removed", "spans", "rest"])

    cut = Written(compressed(docs, length).join(repeats.ranges.hint("merge"), ["k1", "k2"]).mapInArrow(run, "k1 long, k2 long, removed long, spans long, rest string"), "cut").df
    copies = repeats.classes.filter("copies > 1").select("k1", "k2", F.lit(True).alias("copied"))
    of = repeats.scanned.join(copies.join(cut, ["k1", "k2"], "full"), ["k1", "k2"], "left")
    gone = F.col("copied") & (F.col("n") >= length)
    return of.select(
        F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_bytes"),
        F.when(gone, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(_EMPTY)).otherwise(F.coalesce("rest", "sha")).alias("kept_sha256"),
    )


def in_bytes(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of bytes, each up to the next word."""
    at = [x.start() for x in re.finditer(rb"\S+", text)]
    return [(at[a], at[b] if b < len(at) else len(text)) for a, b in spans]


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, matcher: Callable = hashed_matcher, words: int | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, the removed bytes cut from ``text``.

    ``words``: what lies in a repeated window of so many words goes too (more than WORDS_K), however few bytes it has.
    Where a cut runs through a character, what is left of it goes too. Null texts stay null, and texts that repeat as a
    whole become empty; no row goes. Columns of any name are kept as they are. An empty table gives an empty result.
    """
    k1_, k2_, copied_, ranges_, words_ = fresh(docs, "k1", "k2", "copied", "ranges", "words")
    repeats = Repeats(docs, length, k, matcher, keep_scan=False)
    of_words = repeats.ranges.filter("false")
    if words is not None:
        of_words = Repeats(docs, words, WORDS_K, partial(hashed_matcher, unit=np.uint64), keep_scan=False, unit=np.uint64).ranges
    plain = docs.withColumn("text", F.col("text").cast("string"))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [key_of(x) for x in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.int64())], names=[*b.schema.names, k1_, k2_])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            out = []
            for text, copied, ranges, by_word in zip(*(b.column(c).to_pylist() for c in (at, copied_, ranges_, words_)), strict=True):
                data = text.encode() if text and (copied or ranges or by_word) else b""
                if copied and (len(data) >= length or (words is not None and len(data.split()) >= words)):
                    text = ""
                elif ranges or by_word:
                    spans = covered(ranges or [], length) + (in_bytes(data, covered(by_word, words)) if by_word else [])
                    text = kept(data, sorted(spans)).decode("utf-8", "ignore")
                out.append(text)
            columns = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(b.columns)][:-3]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-3])

    both = T.StructType([*plain.schema.fields, T.StructField(k1_, T.LongType()), T.StructField(k2_, T.LongType())])
    copies = repeats.classes.filter("copies > 1").select("k1", "k2", F.lit(True).alias(copied_))
    what = copies.join(repeats.ranges.withColumnRenamed("ranges", ranges_), ["k1", "k2"], "full").join(of_words.withColumnRenamed("ranges", words_), ["k1", "k2"], "full").withColumnsRenamed({"k1": k1_, "k2": k2_})
    joined = plain.mapInArrow(classed, both).join(what.hint("merge"), [k1_, k2_], "left").select(*plain.columns, copied_, ranges_, words_)
    return joined.mapInArrow(cut, plain.schema)


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = max(at, b)
    return b"".join([*out, text[at:]])
