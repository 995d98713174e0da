"""Classes of equal vectors, which both embedding operators work on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from orbweave.llm.store import ready


def usable(values: list | None) -> bytes:
    """The components as little-endian doubles; nothing for vectors that are null, empty, zero or not finite."""
    if not values or None in values:
        return b""
    v = np.array(values, "<f8")
    return v.tobytes() if np.isfinite(v).all() and v.any() else b""


def keyed(rows: DataFrame, group: Column) -> DataFrame:
    """(vec_id, grp, k1, k2, v) of each row of ``rows`` (vec_id, embedding): ``v`` is null if the vector is unusable.

    k1 and k2 hash the group and the vector together; equal vectors of different groups are different classes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = [usable(x) for x in b.column(2).to_pylist()]
            keys = np.array([np.frombuffer(xxh3_128_digest(b"%d " % (g or 0) + v), "<i8") for g, v in zip(b.column(1).to_pylist(), vs, strict=True)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([v or None for v in vs], pa.binary())], names=["vec_id", "grp", "k1", "k2", "v"])

    ready(rows.sparkSession)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), group.cast("long").alias("grp"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, grp long, k1 long, k2 long, v binary")


def matrix(vs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vs), "<f8").reshape(len(vs), -1)
