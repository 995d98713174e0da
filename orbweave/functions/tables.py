"""Tables written to the shared folder of the session, to cut lineage between supersteps.

The folder is the one named in ``spark.checkpoint.dir``. A table there outlives any executor, so a superstep
that loses one starts again from the last table and not from the edge list.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, one of our own in local mode, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orbweave-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give the executors this package before Python runs there: as a zip archive, once a context."""
    sc = spark.sparkContext
    if not getattr(sc, "_has_orbweave", False):
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="orbweave-")) / "orbweave.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(archive))
        sc._has_orbweave = True


def folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for files of our own, which ``discard`` deletes with the tables."""
    path = f"{shared_dir(spark)}/orbweave/{name}-{uuid.uuid4().hex}"
    _known(spark)[path] = None
    return path


class Written:
    """A table in the shared folder: ``df`` reads it, ``drop()`` deletes it.

    With ``by``, rows lie in buckets of that column, as many as the session has shuffle partitions, so that
    joins on it don't shuffle the table.
    """

    def __init__(self, df: DataFrame, name: str, by: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/orbweave/{name}-{uuid.uuid4().hex}"
        self.table = None
        if by is None:
            df.write.option("compression", "zstd").parquet(self.path)
            self.df = self.spark.read.schema(df.schema).parquet(self.path)
        else:
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.table = f"orbweave_{uuid.uuid4().hex}"
            df.repartition(parts, by).write.option("compression", "zstd").option("path", self.path).bucketBy(parts, by).sortBy(by).saveAsTable(self.table)
            self.df = self.spark.table(self.table)
        _known(self.spark)[self.path] = self.table

    def drop(self) -> None:
        delete(self.spark, self.path)


def _known(spark: SparkSession) -> dict[str, str | None]:
    """Paths of the session's tables, and the names of those that have one; nothing that would keep a plan alive."""
    if not hasattr(spark.sparkContext, "_orbweave_tables"):
        spark.sparkContext._orbweave_tables = {}
    return spark.sparkContext._orbweave_tables


def delete(spark: SparkSession, at: str) -> None:
    table = _known(spark).pop(at, None)
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession) -> int:
    """Delete all tables that this session still has in the shared folder, once their results aren't needed any more."""
    paths = list(_known(spark))
    for at in paths:
        delete(spark, at)
    return len(paths)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[Written]]:
    """Within it, append to the list which of the tables written are to stay; the others are deleted at its end.

    Then the driver collects its garbage, without which Spark keeps the shuffle files of jobs that are done.
    """
    before, keep = set(_known(spark)), []
    yield keep
    for at in set(_known(spark)) - before - {x.path for x in keep}:
        delete(spark, at)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
