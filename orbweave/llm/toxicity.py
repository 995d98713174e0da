"""Toxicity: a logistic regression on character n-grams scaled by naive Bayes log-count ratios (NB-SVM).

A text, lower-cased and with everything but letters, digits and non-ASCII bytes as single spaces, has the
n-grams of ``ORDERS`` bytes, each hashed to one of 2^20 features and counted once a text. From the labelled
sample come, for each feature, the log ratio of its smoothed rates in toxic and other texts, and the signed
chi-square of the two document frequencies. The features with the largest chi-squares are kept (a parameter);
the classifier is fitted on them with each feature scaled by its log ratio, with an L2 penalty.

The sample is bounded (``per_class``); statistics of the features are counted on the executors, and the
driver gets the kept features and each sampled text's list of them. Scoring reads whole texts once, a block
at a time; weights are one table of 2^20 floats.

Edge cases: null and empty texts, and texts with no kept feature, get the score of the intercept; if either
class has no row to learn from, every score is the share of the class that has (0.5 if neither has).
Repeated rows are scored alike; a null doc_id counts as the empty text for the fold and is never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.classify import class_counts, labelled_sample, sigmoid
from orbweave.llm.store import Written, blocks, ready

ORDERS = (3, 4, 5, 6)
BITS = 20
BLOCK = 1 << 18
SCORED = "doc_id long, held_out boolean, score double, predicted int"

_KEPT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_GAP = b"\0" * (max(ORDERS) - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> bytes:
    words = (text or "").lower().encode("utf-8", "replace").translate(_KEPT).split()
    return b" " + b" ".join(words) + b" " if words else b""


def hashed(data: np.ndarray, n: int) -> np.ndarray:
    """Feature of the n bytes from each position on; -1 where they hold a gap between texts."""
    g = data[: len(data) - n + 1].astype(np.uint64)
    gap = data[: len(data) - n + 1] == 0
    for k in range(1, n):
        g |= data[k : len(data) - n + 1 + k].astype(np.uint64) << np.uint64(8 * k)
        gap |= data[k : len(data) - n + 1 + k] == 0
    h = ((g * _FACTOR ^ np.uint64(n)) * _FACTOR >> np.uint64(64 - BITS)).astype(np.int32)
    h[gap] = -1
    return h


def features(text: bytes, flags: np.ndarray) -> np.ndarray:
    """All features a text has, each once; ``flags``: 2^BITS false values, left as they were."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK + len(_GAP)]
        for n in ORDERS:
            if len(part) >= n:
                flags[hashed(part, n)[:BLOCK]] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


def present(texts: list[bytes], kept: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, feature) of each ``kept`` feature that a text has, once.

    Goes over the texts in blocks; a text is never split between two of what is given.
    """
    for a, b in blocks(texts, BLOCK):
        joined = np.frombuffer(_GAP.join([*texts[a:b], b""]) + _GAP, np.uint8)
        starts = np.cumsum([0, *(len(x) + len(_GAP) for x in texts[a:b])])[:-1]
        found = []
        for at in range(0, len(joined), BLOCK):
            part = joined[at : at + BLOCK + len(_GAP)]
            for n in ORDERS:
                if len(part) < n:
                    continue
                h = hashed(part, n)[:BLOCK]
                pos = np.flatnonzero(kept[h] & (h >= 0))
                of = np.searchsorted(starts, pos + at, "right") - 1
                found.append(np.unique((of.astype(np.int64) << BITS) | h[pos]))
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        yield a + (keys >> BITS), keys & ((1 << BITS) - 1)


class Model:
    """Weights of the kept features and the intercept."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, intercept: float):
        self.kept = np.zeros(1 << BITS, bool)
        self.kept[features] = True
        self.weights = np.zeros(1 << BITS)
        self.weights[features] = weights
        self.intercept = intercept

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        z = np.full(len(texts), self.intercept)
        for of, feature in present(texts, self.kept):
            z += np.bincount(of, self.weights[feature], len(texts))
        return sigmoid(z)


def fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, penalty: float, steps: int = 2000) -> tuple[np.ndarray, float]:
    """Weights and intercept of the penalised logistic loss; ``rows``: the columns each text has, valued ``ratio``.

    Accelerated gradient steps with restarts, from zero; deterministic.
    """
    of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in rows])
    col = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32)
    each = ratio[col]
    n, m = len(rows), len(ratio)
    size = np.bincount(of, each * each, n).max(initial=0) + 1
    rate = 1 / (0.25 * size + penalty)
    w, b = np.zeros(m), 0.0
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        gap = sigmoid(np.bincount(of, each * v[col], n) + c) - y
        gw, gb = np.bincount(col, each * gap[of], m) / n + penalty * v, gap.mean()
        new_w, new_b = v - rate * gw, c - rate * gb
        if (gw * (new_w - w)).sum() + gb * (new_b - b) > 0:
            t = 1.0
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / following * (new_w - w), new_b + (t - 1) / following * (new_b - b)
        w, b, t = new_w, new_b, following
    return w * ratio, b


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, per_class: int = 4000, most: int = 4000, penalty: float = 1e-6) -> Model | float:
    """A model from at most about ``per_class`` rows of each class with ``learn_from``; a constant where a class is missing."""
    ready(docs.sparkSession)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, flags = np.zeros((2, 1 << BITS), np.int64), np.zeros(1 << BITS, bool)
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                df[y, features(plain(text), flags)] += 1
        seen = np.flatnonzero(df.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, df[0, seen], df[1, seen])], names=["feature", "n0", "n1"])

    counts = class_counts(labels, "toxic", learn_from)
    if not (counts.get(0) and counts.get(1)):
        return 1.0 if counts.get(1) else 0.0 if counts.get(0) else 0.5
    sample = Written(labelled_sample(docs, labels, "toxic", learn_from, per_class, 3), "toxic").df
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not (n0 and n1):
        return counts[1] / (counts[0] + counts[1])
    df = sample.mapInArrow(frequencies, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p, q = F.col("n1") / n1, F.col("n0") / n0
    mean = (F.col("n1") + F.col("n0")) / (n1 + n0)
    power = (p - q) * (p - q) / (mean * (1 - mean) + 1e-9) / (1 / n0 + 1 / n1)
    best = df.filter(F.col("n0") + F.col("n1") >= 3).withColumn("chi", power).filter("chi > 4").orderBy(F.col("chi").desc(), "feature").limit(most).toArrow()
    kept = best.column("feature").to_numpy()
    if not len(kept):
        return counts[1] / (counts[0] + counts[1])
    ratio = np.log((best.column("n1").to_numpy() + 1) / (n1 + 2)) - np.log((best.column("n0").to_numpy() + 1) / (n0 + 2))
    wanted = np.zeros(1 << BITS, bool)
    wanted[kept] = True
    mask = docs.sparkSession.sparkContext.broadcast(wanted)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [plain(x) for x in b.column(0).to_pylist()]
            own: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
            for of, feature in present(texts, mask.value):
                for k in np.unique(of):
                    own[k] = feature[of == k].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x.tobytes() for x in own], pa.binary())], names=["y", "features"])

    got = sample.mapInArrow(lists, "y int, features binary").toArrow()
    y = got.column("y").to_numpy().astype(np.float64)
    column = np.full(1 << BITS, -1, np.int32)
    column[kept] = np.arange(len(kept))
    rows = [column[np.frombuffer(x.as_py(), np.int32)] for x in got.column("features")]
    weights, intercept = fit(rows, y, ratio, penalty)
    prior = np.log(counts[1] / counts[0]) - np.log(n1 / n0)  # the sample holds more of the rarer class
    return Model(kept, weights, float(intercept + prior))


def score(docs: DataFrame, model: Model | float, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text), all texts whole."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            s = np.full(b.num_rows, known) if isinstance(known, float) else known([plain(x) for x in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)
