"""What the two text classifiers share: bounded labelled samples and fitting by Newton or gradient steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int, seed: int) -> DataFrame:
    """(text, y): at most about ``bound`` rows of each class, by a hash of the id.

    Rows with a null id, a label other than 0 or 1, or for which ``learn`` (a condition on doc_id) is false
    are left out. The labels table is counted and thinned first; what remains is bounded, so it is broadcast
    and the texts are never shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, F.lit(int(min(1.0, bound / max(n.get(1, 0), 1)) * (1 << 30)))).otherwise(F.lit(int(min(1.0, bound / max(n.get(0, 0), 1)) * (1 << 30))))
    few = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(few), "doc_id").select("text", "y")


def class_counts(labels: DataFrame, label: str, learn: Column) -> dict[int, int]:
    """How many rows of each class may be learned from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    return {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))
