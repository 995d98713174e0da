import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import quality, toxicity
from orbweave.llm.store import fold

RNG = random.Random(3)
WORDS = ["anland", "thering", "ofor", "ention", "hester", "ouble", "edness"]


def text(n, extra=()):
    w = [RNG.choice(WORDS) + RNG.choice(WORDS) for _ in range(n)] + list(extra)
    RNG.shuffle(w)
    return " ".join(w)


def tables(spark, good, bad, label):
    rows = [(k, t) for k, t in enumerate(x for pair in zip(good, bad, strict=True) for x in pair)]
    marks = [(k, None if label == "toxic" else 1 - k % 2, k % 2 if label == "toxic" else None) for k, _ in rows]
    odd = [(9000, None), (9001, ""), (None, "anland"), (9002, "ofor " * 60_000)]
    docs = spark.createDataFrame([(a, b, "clash") for a, b in rows + odd], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([*marks, (None, 1, 1), (9000, None, None), (9001, 7, 7)], "doc_id long, quality int, toxic int"), dict((k, (q, t)) for k, q, t in marks)


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_rows(spark, module, label):
    if label == "toxic":
        good, bad = [text(RNG.randrange(5, 80)) for _ in range(150)], [text(RNG.randrange(5, 80), ["wretchedfool", "Scumling"]) for _ in range(150)]
    else:
        good, bad = [text(RNG.randrange(5, 80)) + "." for _ in range(150)], [text(RNG.randrange(5, 80)).replace(" ", "### ").upper() for _ in range(150)]
    docs, labels, truth = tables(spark, good, bad, label)
    held = fold(F.col("doc_id"), 3) == 1
    got = {r.doc_id: r for r in module.score(docs, module.learn(docs, labels, ~held), held).collect()}
    assert len(got) == 304
    right = [got[k].predicted == (t if label == "toxic" else q) for k, (q, t) in truth.items() if got[k].held_out]
    assert len(right) > 60
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_without_labels_or_rows(spark, module, label):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for marks, want in (([], 0.5), ([(1, 1, 1)], 1.0), ([(1, 0, 0)], 0.0)):
        labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
        got = module.score(docs, module.learn(docs, labels, F.lit(True)), F.lit(False)).collect()
        assert [r.score for r in got] == [want, want]
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert module.score(docs.limit(0), module.learn(docs, labels, F.lit(True)), F.lit(False)).count() == 0


def test_toxicity_scores_from_their_definition(spark):
    """Every score of the query over a whole table, summed feature by feature in plain Python."""
    from orbweave.llm.store import fold

    at = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels, fold(F.col("doc_id"), 3) != 1)
    factor, most = 0x9E3779B97F4A7C15, 1 << 64

    def brute(text):
        data = toxicity.plain(text)
        found = set()
        for n in toxicity.ORDERS:
            for a in range(len(data) - n + 1):
                g = int.from_bytes(data[a : a + n], "little")
                found.add((((g * factor % most) ^ n) * factor % most) >> (64 - toxicity.BITS))
        z = model.intercept + sum(model.weights[f] for f in sorted(found) if model.kept[f])
        return 1 / (1 + np.exp(-z))

    got = {r.doc_id: r for r in toxicity.score(docs, model, fold(F.col("doc_id"), 3) == 1).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) == len(got) == 200
    for r in rows:
        assert abs(got[r.doc_id].score - brute(r.text)) < 1e-9
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


def test_quality_scores_from_their_definition(spark):
    """The log-density difference from covariances and determinants, not from cached factors."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, quality.WIDTH)) @ rng.standard_normal((quality.WIDTH, quality.WIDTH))
    y = (rng.random(300) < 0.4).astype(int)
    x[y == 1] += 1
    pooled, round_, prior = 0.2, 0.05, -0.3
    model = quality.Gaussians(x, y, pooled, round_, prior)
    z = (x - x.mean(0)) / x.std(0)
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    common = sum((y == k).mean() * own[k] for k in (0, 1))
    density = []
    for k in (0, 1):
        c = (1 - pooled) * own[k] + pooled * common
        c = (1 - round_) * c + round_ * np.trace(c) / quality.WIDTH * np.eye(quality.WIDTH)
        away = z - z[y == k].mean(0)
        density.append(-0.5 * (np.einsum("ij,ij->i", away, np.linalg.solve(c, away.T).T) + np.linalg.slogdet(c)[1]))
    assert np.abs(model.log_odds(x) - (density[1] - density[0] + prior)).max() < 1e-6
    texts = ["a plain text. " * 9, "", None, "!!! ### $$$", "é" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(df, model, F.lit(False)).collect()}
    for k, t in enumerate(texts):
        assert abs(got[k] - float(model(np.array([quality.statistics((t or "").encode())]))[0])) < 1e-12
