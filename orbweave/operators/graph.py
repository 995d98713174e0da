"""A directed multigraph as DataFrames, and what can be read off it.

Loops make a vertex but no adjacency; parallel edges stay and count everywhere.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.columns import neighbor_list, partition_of


class Graph:
    """``raw``: (src, dst), any integers. Everything else is derived from it on demand."""

    def __init__(self, raw: DataFrame):
        self.raw = raw.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))

    @property
    def spark(self):
        return self.raw.sparkSession

    @cached_property
    def edges(self) -> DataFrame:
        """The edges that aren't loops."""
        return self.raw.filter("src <> dst")

    @cached_property
    def vertices(self) -> DataFrame:
        """(id) of all ends, those of loops too."""
        return self.raw.select(F.explode(F.array("src", "dst")).alias("id")).distinct()

    @cached_property
    def degrees(self) -> DataFrame:
        """(id, in_degree, out_degree), parallel edges counted; one aggregation over the edges' ends."""
        ends = self.raw.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"), (F.col("src") != F.col("dst")).cast("long").alias("k"))
        return ends.groupBy("e.id").agg(F.sum(F.col("e.i") * F.col("k")).alias("in_degree"), F.sum(F.col("e.o") * F.col("k")).alias("out_degree"))

    def in_neighbors(self) -> DataFrame:
        """(id, neighbors) of vertices with an in-edge. Arrays as long as a vertex's degree: for export only."""
        return self.edges.groupBy(F.col("dst").alias("id")).agg(neighbor_list("src").alias("neighbors"))

    def out_neighbors(self) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("id")).agg(neighbor_list("dst").alias("neighbors"))

    def high(self, threshold: int) -> DataFrame:
        """(id) of vertices with more in-edges than ``threshold``."""
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") > threshold).select("id")

    def degree_classes(self, threshold: int) -> DataFrame:
        """(degree_class, n_vertices) of ``low`` and ``high``."""
        named = F.when(F.col("in_degree") > threshold, "high").otherwise("low")
        return self.degrees.groupBy(named.alias("degree_class")).agg(F.count("*").alias("n_vertices"))

    def partition_sizes(self, parts: int) -> DataFrame:
        """(part, n_vertices, n_edges): the vertices a partition owns and the edges that end in one of them."""
        owned = self.vertices.groupBy(partition_of(F.col("id"), parts).alias("part")).agg(F.count("*").alias("n_vertices"))
        ending = self.edges.groupBy(partition_of(F.col("dst"), parts).alias("part")).agg(F.count("*").alias("n_edges"))
        return owned.join(ending, "part", "left").select("part", "n_vertices", F.coalesce("n_edges", F.lit(0).cast("long")).alias("n_edges"))

    def edge_placement(self, parts: int, threshold: int) -> DataFrame:
        """(part, n_low, n_high) of the hybrid cut: edges into low vertices lie with their end, into high ones with their start."""
        marked = self.edges.join(self.high(threshold).withColumn("is_high", F.lit(True)), F.col("dst") == F.col("id"), "left")
        is_high = F.coalesce("is_high", F.lit(False))
        part = F.when(is_high, partition_of(F.col("src"), parts)).otherwise(partition_of(F.col("dst"), parts))
        return marked.groupBy(part.alias("part")).agg(F.sum((~is_high).cast("long")).alias("n_low"), F.sum(is_high.cast("long")).alias("n_high"))

    def _low_mirrors(self, parts: int, threshold: int) -> DataFrame:
        high = self.high(threshold)
        crossing = self.edges.select("src", "dst", partition_of(F.col("src"), parts).alias("home"), partition_of(F.col("dst"), parts).alias("part")).filter("home <> part")
        low_ends = crossing.join(high.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return low_ends.select("src", "part").distinct().join(high.withColumnRenamed("id", "src"), "src", "left_anti")

    def mirror_sets(self, parts: int, threshold: int) -> DataFrame:
        """(id, mirrors): partitions other than its own in which a low vertex is needed, comma-joined."""
        return self._low_mirrors(parts, threshold).groupBy(F.col("src").alias("id")).agg(neighbor_list("part").alias("mirrors"))

    def load_stats(self, parts: int, threshold: int) -> DataFrame:
        """One row: low_master, high_master, low_mirror, high_mirror of the hybrid cut."""
        n = self.vertices.agg(F.count("*").alias("n"))
        high = self.high(threshold).agg(F.count("*").alias("h"))
        low = self._low_mirrors(parts, threshold).agg(F.count("*").alias("m"))
        # three one-row tables, so these joins are of single rows
        return n.crossJoin(high).crossJoin(low).select((F.col("n") - F.col("h")).alias("low_master"), F.col("h").alias("high_master"), F.col("m").alias("low_mirror"), (F.col("h") * (parts - 1)).alias("high_mirror"))
