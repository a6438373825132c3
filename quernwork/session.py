"""Spark sessions and the settings they need at size."""

from __future__ import annotations

from pyspark.sql import SparkSession

# A shuffle partition of this size sorts in memory on an ordinary executor.
TARGET_PARTITION_BYTES = 200 * 1024 * 1024

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    # Written checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Noting the Python line behind every column takes longer than building it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def shuffle_partitions(shuffled_bytes: int, cores: int) -> int:
    """How many partitions keep each one near the target size.

    Never fewer than the cores there are, so that no core is left idle. AQE
    merges those that turn out small.
    """
    by_size = -(-shuffled_bytes // TARGET_PARTITION_BYTES)
    return max(cores, by_size)


def build_session(
    app: str = "quernwork",
    master: str | None = None,
    shuffled_bytes: int | None = None,
    cores: int = 1,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session sized for ``shuffled_bytes`` of shuffle on ``cores`` cores.

    AQE merges shuffle partitions but never makes more, so their number is set only
    from a size that is given; without one it stays what Spark or ``conf`` says.
    """
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    settings = dict(DEFAULTS)
    if shuffled_bytes is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions(shuffled_bytes, cores))
    for key, value in (settings | (conf or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
