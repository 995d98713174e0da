"""Readers and writers of edge lists (src, dst)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = "src long, dst long"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Two integers a line, split by white space; lines that start with ``#`` and blank lines are skipped.

    A line that isn't two integers fails the job instead of passing as something else.
    """
    line = F.trim(F.col("value"))
    parts = F.split(line, r"\s+")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (line != ""))
    ok = line.rlike(r"^-?\d+\s+-?\d+$")
    checked = F.when(ok, parts).otherwise(F.raise_error(F.concat(F.lit("not an edge: "), F.col("value"))).cast("array<string>"))
    return rows.select(checked.alias("p")).select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst"))


def write_text(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("overwrite").text(path)


def _sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    return [(f.getPath().toString(), f.getLen()) for f in fs.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]


def read_binary(spark: SparkSession, path: str, signed: bool = False) -> DataFrame:
    """Packed pairs of little-endian 4-byte integers, unsigned unless ``signed``; a file or a folder of them.

    Files are split at record boundaries. A missing path, and a file with part of a record at its end, raise.
    """
    files = _sizes(spark, path)
    for name, size in files:
        if size % 8:
            raise ValueError(f"{name}: {size} bytes are no whole number of 8-byte edges")
    if not any(size for _, size in files):
        return spark.createDataFrame([], EDGES)
    records = spark.sparkContext._jsc.binaryRecords(path, 8)
    raw = DataFrame(spark._jsparkSession.createDataset(records.rdd(), spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)

    def number(at: int) -> Column:
        big = F.concat(*[F.substring("value", at + k, 1) for k in (3, 2, 1, 0)])
        n = F.conv(F.hex(big), 16, 10).cast("long")
        return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n) if signed else n

    return raw.select(number(1).alias("src"), number(5).alias("dst"))


def write_binary(edges: DataFrame, path: str, signed: bool = False) -> None:
    """One packed file a partition in the folder ``path``, on any file system that Arrow opens by its URI (files, HDFS, object stores).

    Ids that don't fit in four bytes fail the job.
    """
    kind = np.dtype("<i4" if signed else "<u4")
    least, most = np.iinfo(kind).min, np.iinfo(kind).max
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(uri)
        store.create_dir(folder)
        k, attempt, n = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        unfinished = f"{folder}/.part-{k:05d}-{attempt}"
        with store.open_output_stream(unfinished) as f:
            for b in batches:
                pairs = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)
                if len(pairs) and (pairs.min() < least or pairs.max() > most):
                    raise ValueError("an id doesn't fit in four bytes")
                f.write(pairs.astype(kind).tobytes())
                n += len(pairs)
        store.move(unfinished, f"{folder}/part-{k:05d}.bin")  # a task that runs again replaces its own file
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def undirected(edges: DataFrame) -> DataFrame:
    """Each unordered pair once, the smaller end first; a loop stays."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
