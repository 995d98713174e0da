"""Quality: regularised quadratic discriminant analysis of transformed document statistics.

A document is a vector of statistics of its whole text (sizes, shares of character kinds, words, lines and
repetition), transformed to be near normal and standardised. Each class has a Gaussian whose covariance is
shrunk twice: towards the pooled covariance and towards a multiple of the identity. The two weights are
chosen on the sample by cross-validated log loss. The score is the posterior of class 1: the difference of
the log densities, by Mahalanobis distances through Cholesky factors that are computed once, plus the log
ratio of the labelled classes' sizes.

The sample is bounded (``per_class`` rows of each class); the driver gets one short vector for each of its
rows. Scoring reads each text once.

Edge cases: null and empty texts have the vector of the empty text and are scored like any other; if either
class has no row to learn from, every score is the share of the class that has (0.5 if neither has).
Repeated rows are scored alike; a null doc_id counts as the empty text for the fold and is never learned from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.classify import class_counts, labelled_sample, sigmoid
from orbweave.llm.store import as_bytes, ready

SCORED = "doc_id long, held_out boolean, score double, predicted int"


def _kind(test) -> np.ndarray:
    return np.array([test(chr(b)) if b < 128 else False for b in range(256)], bool)


_UPPER, _LOWER, _DIGIT = _kind(str.isupper), _kind(str.islower), _kind(str.isdigit)
_SPACE = _kind(str.isspace)
_HIGH = np.arange(256) >= 128
_STOP, _PAUSE, _LOUD = (_kind(lambda c, s=s: c in s) for s in (".?", ",;:'\"()-", "!"))
_BAR, _SIGN = _kind(lambda c: c in "|/\\_=<>[]{}~^`"), _kind(lambda c: c in "#$%&*@+")
_PUNCTUATION = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH)
_EDGE = bytes(b for b in range(33, 128) if not chr(b).isalnum())


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text, all finite."""
    n = len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if n else np.zeros(256, np.int64)

    def share(kind: np.ndarray, of: float) -> float:
        return float(np.sqrt(count[kind].sum() / of)) if of else 0.0

    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = count[_UPPER].sum() + count[_LOWER].sum() + count[_HIGH].sum()
    marks = count[_PUNCTUATION]
    p = marks[marks > 0] / max(marks.sum(), 1)
    bare = sum(1 for w in words if not w.strip(_EDGE))
    sizes = np.array([len(w) for w in words], np.float64)
    return [
        np.log1p(n),
        np.log1p(len(words)),
        share(_UPPER, letters),
        share(_DIGIT, n),
        share(_SPACE, n),
        share(_HIGH, n),
        share(_STOP, len(words)),
        share(_PAUSE, len(words)),
        share(_LOUD, len(words)),
        share(_BAR, len(words)),
        share(_SIGN, len(words)),
        float(-(p * np.log(p)).sum()) if len(p) else 0.0,
        float(np.log1p(sizes.mean())) if len(words) else 0.0,
        float(np.log1p(sizes.std())) if len(words) else 0.0,
        float(np.sqrt(bare / len(words))) if words else 0.0,
        float(len(set(words)) / np.sqrt(len(words))) / 10 if words else 0.0,
        float(np.log1p(n / max(len(lines), 1))),
        float(np.sqrt(1 - len(set(lines)) / len(lines))) if lines else 0.0,
        float(np.sqrt(min(1.0, len(zlib.compress(text, 1)) / n))) if n else 0.0,
    ]


WIDTH = len(statistics(b""))


class Gaussians:
    """Two shrunk Gaussians over standardised vectors, by their means and Cholesky factors."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pooled: float, round_: float, prior: float):
        self.centre, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = (x - self.centre) / self.scale
        parts = [z[y == k] for k in (0, 1)]
        spreads = [(p - p.mean(0)).T @ (p - p.mean(0)) for p in parts]
        common = sum(spreads) / len(z)
        self.means, self.factors, self.logdet = [p.mean(0) for p in parts], [], []
        for p, s in zip(parts, spreads, strict=True):
            c = (1 - pooled) * s / len(p) + pooled * common
            c = (1 - round_) * c + round_ * max(np.trace(c) / WIDTH, 1e-3) * np.eye(WIDTH)
            factor = np.linalg.cholesky(c)
            self.logdet.append(2 * np.log(np.diag(factor)).sum())
            self.factors.append(np.linalg.inv(factor))
        self.prior = prior

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        away = [(((z - m) @ f.T) ** 2).sum(1) for m, f in zip(self.means, self.factors, strict=True)]
        return 0.5 * (away[0] - away[1] + self.logdet[0] - self.logdet[1]) + self.prior

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.log_odds(x))


def fit(x: np.ndarray, y: np.ndarray, prior: float, folds: int = 4) -> Gaussians:
    """The pair of shrinkage weights with the least cross-validated log loss, fitted on all rows."""
    best = (np.inf, 0.5, 0.1)
    fold = np.arange(len(y)) % folds
    for pooled in (0.05, 0.2, 0.5, 0.9):
        for round_ in (0.01, 0.05, 0.2):
            loss = 0.0
            for k in range(folds):
                a = fold != k
                if len(set(y[a].tolist())) < 2:
                    continue
                odds = Gaussians(x[a], y[a], pooled, round_, 0.0).log_odds(x[~a])
                loss += np.logaddexp(0, np.where(y[~a] == 1, -odds, odds)).sum()
            best = min(best, (loss, pooled, round_))
    return Gaussians(x, y, best[1], best[2], prior)


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, per_class: int = 5000) -> Gaussians | float:
    """A model from at most about ``per_class`` rows of each class with ``learn_from``; a constant where a class is missing."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([statistics(x) for x in as_bytes(b.column(0))], pa.list_(pa.float64()))], names=["y", "x"])

    counts = class_counts(labels, "quality", learn_from)
    if not (counts.get(0) and counts.get(1)):
        return 1.0 if counts.get(1) else 0.0 if counts.get(0) else 0.5
    got = labelled_sample(docs, labels, "quality", learn_from, per_class, 8).mapInArrow(run, "y int, x array<double>").toArrow()
    y = got.column("y").to_numpy()
    if len(set(y.tolist())) < 2 or np.bincount(y).min() < 3:
        return counts[1] / (counts[0] + counts[1])
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, WIDTH)
    order = np.lexsort((*x.T, y))  # the same at any partitioning
    return fit(x[order], y[order], float(np.log(counts[1] / counts[0])))


def score(docs: DataFrame, model: Gaussians | float, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text), all texts whole."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            if isinstance(known, float) or not b.num_rows:
                s = np.full(b.num_rows, known if isinstance(known, float) else 0.0)
            else:
                s = known(np.array([statistics(x) for x in as_bytes(b.column(2))]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)
