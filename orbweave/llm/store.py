"""Written tables in the shared folder, and reading text columns as bytes.

Every operator here that reads an intermediate more than once writes it as Parquet below the folder named
in ``spark.checkpoint.dir`` and reads it back. A table written there survives the loss of any executor,
cuts the lineage, and keeps partition contents fixed, which the numbering in some operators relies on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.tables import Written, shared_dir, ship, temporary

__all__ = ["Written", "as_bytes", "below_rate", "blocks", "fold", "fresh", "ready", "shared_dir", "temporary"]

#: Rows in one Arrow batch. Texts can be long; Spark's default of 10,000 rows would hold too many of them at once.
BATCH_ROWS = 512
#: Bytes after which a batch is closed.
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> None:
    """Before Python runs on executors: give them this package, and bound the rows and bytes of an Arrow batch.

    The package goes to the executors as a zip archive, once a context; a session that asks for smaller
    batches keeps them.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(min(BATCH_BYTES, int(spark.conf.get(key, str(BATCH_BYTES)).rstrip("b")))))
    ship(spark)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores before it until no column of ``df`` has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def below_rate(key: Column, seed: int, rate: float) -> Column:
    """True for a share ``rate`` of the keys, the same ones at any partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(min(1.0, rate) * (1 << 30)))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Runs [from, to) of at most ``most`` bytes, or of one text that is longer."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)
