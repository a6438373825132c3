"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from quernwork.sources.shared import ensure_checkpoint_dir, new_folder

# Rows and bytes of one Arrow batch, which is all that a Python task holds of its input.
# Texts may be long, so batches stay far below the default of 10,000 rows; what is longer
# than the bytes is a batch of its own.
BATCH_ROWS = 512
BATCH_BYTES = 24 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that go to Python small in this session.

    Spark reads the settings when a plan runs, not when it is built, so they are the same
    for all operators.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores in front until no column in ``taken`` has that name."""
    used = {name.lower() for name in taken}
    while base.lower() in used:
        base = f"_{base}"
    return base


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, of which a reader may take single columns."""
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
