"""Sinks for results, and the benchmark averager."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.columns import PALETTE, dot_line


def component_dot(components: DataFrame, palette: tuple[str, ...] = PALETTE) -> DataFrame:
    """A DOT node (``line``) for each row of (id, component), coloured by the rank of its label.

    More labels than colours raise; labels beyond those are never collected.
    """
    labels = [r[0] for r in components.select("component").distinct().orderBy("component").limit(len(palette) + 1).collect()]
    if len(labels) > len(palette):
        raise ValueError(f"more than {len(palette)} components; pass a longer palette")
    color = F.lit(None).cast("string")
    for label, name in zip(labels, palette, strict=False):
        color = F.when(F.col("component") == label, name).otherwise(color)
    return components.select(dot_line(F.col("id"), color).alias("line"))


def core_dot(cores: DataFrame, k: int) -> DataFrame:
    """A red DOT node for each row of (id, core_value) in the k-core."""
    return cores.filter(F.col("core_value") >= k).select(dot_line(F.col("id"), "red").alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def bench_average(spark: SparkSession, path: str) -> DataFrame:
    """(name, avg): per folder below ``path``, the mean of the fourth field of the lines with ``computing``."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).filter(F.col("value").contains("computing"))
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    return lines.select(name.alias("name"), F.split("value", r"\s+")[3].cast("double").alias("t")).groupBy("name").agg(F.avg("t").alias("avg"))
