"""Graphs made from the driver's tables, as DataFrames and as the SQL that the oracles start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.operators.graph import Graph

SQL = {
    "events": "SELECT user_id AS src, dst FROM (SELECT user_id, lead(user_id) OVER (ORDER BY event_id) AS dst FROM events) WHERE dst IS NOT NULL",
    "supply": "SELECT 400000000 + l_suppkey AS src, 300000000 + l_partkey AS dst FROM lineitem",
    "chain": "SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_partkey % 100 <> 99",
}

#: Ids in one bucket of the events' order.
BUCKET = 1 << 16


def successors(rows: DataFrame, order: str, value: str) -> DataFrame:
    """(src, dst): each row's ``value`` and the next row's, by ``order``, for rows that have a next one.

    Windows run within buckets of the order; each bucket's last row takes the first value of the next bucket
    there is. Only the buckets' firsts are ordered together.
    """
    bucket = F.floor(F.col(order) / BUCKET)
    cut = rows.select(F.col(order).alias("o"), F.col(value).alias("src"), bucket.alias("b"))
    firsts = cut.groupBy("b").agg(F.min_by("src", "o").alias("first"))
    following = firsts.select("b", F.lead("first").over(Window.orderBy("b")).alias("after"))
    inside = cut.withColumn("dst", F.lead("src").over(Window.partitionBy("b").orderBy("o")))
    return inside.join(following, "b").select("src", F.coalesce("dst", "after").alias("dst")).filter("dst IS NOT NULL")


def edges(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    def read(table: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet")

    if name == "events":
        return successors(read("events"), "event_id", "user_id")
    if name == "supply":
        return read("lineitem").select((F.col("l_suppkey") + 400_000_000).alias("src"), (F.col("l_partkey") + 300_000_000).alias("dst"))
    if name == "chain":
        return read("part").filter(F.col("p_partkey") % 100 != 99).select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"))
    raise KeyError(name)


def graph(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    return Graph(edges(spark, sf_dir, name))


def least_source(g: Graph) -> int:
    """The smallest vertex with an out-edge; 0 in a graph without edges."""
    return g.edges.agg(F.min("src")).first()[0] or 0
