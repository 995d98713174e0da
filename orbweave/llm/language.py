"""Language identification by prediction by partial matching (PPM, escape method C, frozen statistics).

Each language has a byte context tree of depth ``ORDER``: for every context of up to so many bytes, how often
each byte followed. A byte that followed its context ``c`` times costs ``-log2(c / (n + d))`` bits, where ``n``
is the context's total and ``d`` its number of distinct followers; any other costs the escape,
``-log2(d / (n + d))``, and then what the next shorter context asks; below order 0 all 256 bytes are equally
likely. A text's code length under a language is the sum over all its bytes; the shortest wins.

The trees are learned from a bounded sample of the labelled documents, ``per_lang`` expected documents of each
language, drawn by a hash of the id. All contexts of all languages are kept in one table per order, keyed by
the bytes themselves and holding one column for each language, so that a position of the text is looked up
once for all languages: first at full depth, and only where that byte string was never seen, one order down.
Texts are scored whole. Memory: the tables (bounded by the sample) and a block of text.

Before counting and scoring, texts are lower-cased, ASCII characters other than letters become spaces, and
runs of spaces become one. ``und`` with score 0: null texts and those without a letter. The score is the
posterior probability of the language named, all languages being equally likely beforehand, with code lengths
scaled to at most ``SCORE_BYTES`` bytes so that long texts keep a usable score. If no row can be learned from,
every text is ``und``. Repeated rows are scored alike; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.store import blocks, ready

ORDER = 4
SCORE_BYTES = 64
BLOCK = 1 << 18
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"

_LETTER = regex.compile(r"\p{L}")
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_PAD = b"\0" * ORDER


def normalized(text: str | None) -> bytes:
    """What is counted and scored of a text: padded with one space on both sides; empty if nothing is left."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()
    return b" " + b" ".join(words) + b" " if words else b""


def grams(data: np.ndarray) -> np.ndarray:
    """Of each position from ORDER on: the ORDER bytes before it and its own, the own one lowest."""
    out = data[ORDER:].astype(np.uint64)
    for k in range(1, ORDER + 1):
        out |= data[ORDER - k : len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _low(n_bytes: int) -> np.uint64:
    return np.uint64((1 << (8 * n_bytes)) - 1)


class Lookup:
    """Row numbers of distinct 64-bit keys; -1 for others.

    Levels of open tables: keys that share a slot with another go on to the next, smaller level, so a query
    compares one key a level and all its steps are whole-array operations.
    """

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        rows = np.arange(len(keys), dtype=np.int32)
        while len(rows):
            bits = max(4, int(len(rows) * 4).bit_length())
            slot = self._slot(keys[rows], bits, len(self.levels))
            table, row = np.full(1 << bits, ~np.uint64(0)), np.full(1 << bits, -1, np.int32)
            table[slot], row[slot] = keys[rows], rows  # the last one stays
            here = row[slot] == rows
            self.levels.append((bits, table, row))
            rows = rows[~here]

    def _slot(self, keys: np.ndarray, bits: int, level: int) -> np.ndarray:
        return ((keys ^ np.uint64(level * 0x5851F42D4C957F2D % (1 << 64))) * self.MULTIPLIER >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int32)
        todo = None
        for k, (bits, table, row) in enumerate(self.levels):
            ask = keys if todo is None else keys[todo]
            slot = self._slot(ask, bits, k)
            hit = table[slot] == ask
            if todo is None:
                np.copyto(found, row[slot], where=hit)
                todo = np.flatnonzero(~hit)
            else:
                found[todo[hit]] = row[slot[hit]]
                todo = todo[~hit]
            if not len(todo):
                break
        return found


class Trees:
    """Context trees of all languages. ``counts``: per language, strings of ORDER + 1 bytes and how often each occurs."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        n = len(langs)
        self.keys: list[np.ndarray] = []  # by order k: strings of k + 1 bytes that any language has
        self.bits: list[np.ndarray] = []  # their last byte's cost after the others, by language
        self.escape: list[np.ndarray] = []  # by order k: an escape's cost after a context of k bytes
        self.contexts: list[np.ndarray] = []
        below = np.full((256, n), 8.0, np.float32)  # order -1
        for k in range(ORDER + 1):
            per = []
            for gram, count in counts:
                key, at = np.unique(gram & _low(k + 1), return_inverse=True)
                per.append((key, np.bincount(at, count, len(key))))
            keys = np.unique(np.concatenate([key for key, _ in per]))
            context, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            lower = below[keys.astype(np.int64)] if not k else self.bits[-1][np.searchsorted(self.keys[-1], keys & _low(k))]
            bits, escape = np.empty((len(keys), n), np.float32), np.empty((len(context), n), np.float32)
            for i, (key, count) in enumerate(per):
                full = np.zeros(len(keys))
                full[np.searchsorted(keys, key)] = count
                total, distinct = np.bincount(of, full, len(context)), np.bincount(of, full > 0, len(context))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape[:, i] = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0)
                    bits[:, i] = np.where(full > 0, -np.log2(full / (total + distinct)[of]), escape[of, i] + lower[:, i])
            for x, y in zip((self.keys, self.bits, self.contexts, self.escape), (keys, bits, context, escape), strict=True):
                x.append(y)
        self.find = [Lookup(k) for k in self.keys]
        self.find_context = [Lookup(k) for k in self.contexts]

    def cost(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each position's last byte, a column for each language."""
        row = self.find[ORDER](gram)
        out = self.bits[ORDER][row]
        todo = np.flatnonzero(row < 0)
        out[todo] = 0
        for k in range(ORDER, 0, -1):
            if not len(todo):
                return out
            context = self.find_context[k]((gram[todo] & _low(k + 1)) >> np.uint64(8))
            seen = context >= 0
            out[todo[seen]] += self.escape[k][context[seen]]
            row = self.find[k - 1](gram[todo] & _low(k))
            seen = row >= 0
            out[todo[seen]] += self.bits[k - 1][row[seen]]
            todo = todo[~seen]
        out[todo] += self.escape[0][0] + 8
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits of normalised texts, a column for each language."""
        out = np.zeros((len(texts), len(self.langs)))
        for a, b in blocks(texts, BLOCK):
            data = np.frombuffer(b"".join(_PAD + x for x in texts[a:b]), np.uint8)
            size = np.array([len(x) for x in texts[a:b]])
            ends = np.cumsum(size + ORDER) - ORDER
            starts = ends - size
            for at in range(0, len(data) - ORDER, BLOCK):
                part = self.cost(grams(data[at : at + BLOCK + ORDER]))
                here = np.flatnonzero((size > 0) & (starts < at + len(part)) & (ends > at))
                cuts = np.stack([np.maximum(starts[here] - at, 0), np.minimum(ends[here] - at, len(part))], 1).ravel()
                sums = np.add.reduceat(np.vstack([part, np.zeros_like(part[:1])]), cuts, 0, np.float64)
                out[a + here] += sums[::2]
        return out


def learn(docs: DataFrame, per_lang: int = 400, seed: int = 6) -> Trees | None:
    """Trees from a sample of the rows of ``docs`` (doc_id, text, lang), about ``per_lang`` of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = [normalized(x) for x in b.column(0).to_pylist()], b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                data = b"".join(_PAD + x for x, y in zip(texts, langs, strict=True) if y == lang and x)
                if data:
                    gram = grams(np.frombuffer(data, np.uint8))
                    key, n = np.unique(gram[(gram & np.uint64(255)) > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rates = {r["lang"]: min(1.0, per_lang / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rates:
        return None
    ready(docs.sparkSession)
    rate: Column = F.lit(0).cast("long")
    for lang, share in rates.items():
        rate = F.when(F.col("lang") == lang, F.lit(int(share * (1 << 30)))).otherwise(rate)
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < rate)
    table = sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    if not langs:
        return None
    of, key, n = np.array(table.column("lang").to_pylist(), object), table.column("gram").to_numpy().astype(np.uint64), table.column("n").to_numpy().astype(np.float64)
    return Trees(langs, [(key[of == x], n[of == x]) for x in langs])


def named(texts: list[str | None], trees: Trees | None) -> list[tuple[str, float, float | None]]:
    """Language, score and bits per byte of each text."""
    plain = [normalized(x) if trees and x and _LETTER.search(x) else b"" for x in texts]
    bits = trees.lengths(plain) if trees else np.zeros((len(plain), 1))
    out: list[tuple[str, float, float | None]] = []
    for n, row in zip(map(len, plain), bits, strict=True):
        if not n:
            out.append(("und", 0.0, None))
            continue
        k = int(row.argmin())
        with np.errstate(under="ignore"):
            odds = np.exp2((row[k] - row) * min(1.0, SCORE_BYTES / n))
        out.append((trees.langs[k], float(1 / odds.sum()), float(row[k] / n)))
    return out


def identify(docs: DataFrame, trees: Trees | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of each row of ``docs`` (doc_id, text), all texts whole."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = named(b.column(2).to_pylist(), shared.value)
            lang, score, cost = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cost, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, PREDICTED)


def keep(docs: DataFrame, trees: Trees | None, least: float, most_bits: float = 8.0) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a learned language with a score of ``least`` or more.

    A text that takes ``most_bits`` a byte or more under its best language isn't in it either: at 8, the language's
    statistics don't shorten it at all, as with scripts and noise that no language learned from has. Null and empty
    texts and those without a letter go; repeated rows are judged alike; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = named(b.column("text").to_pylist(), shared.value)
            yield b.filter(pa.array([lang != "und" and score >= least and cost < most_bits for lang, score, cost in found], pa.bool_()))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
