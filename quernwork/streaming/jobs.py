"""Running a stream over what its source holds, into a parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Read when a stream starts, so a session of its own keeps them from other work.
STREAM_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # State in RocksDB lies outside the heap and may outgrow it.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Commit what changed, not the whole state, at each trigger.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def event_session(spark: SparkSession) -> SparkSession:
    """A session on the same cluster with the settings the streams here need.

    The number of shuffle partitions is taken over: it fixes how many parts the
    state has for as long as a checkpoint is used.
    """
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"):
        session.conf.set(key, spark.conf.get(key))
    for key, value in STREAM_CONF.items():
        session.conf.set(key, value)
    return session


def run_to_table(result: DataFrame, table: str, checkpoint: str) -> None:
    """Process all that is there now, appending closed windows to ``table``.

    A run that was cut short goes on from ``checkpoint``, and the parquet sink
    keeps each trigger's rows once. Both folders must be shared.
    """
    query = (
        result.writeStream.format("parquet")
        .outputMode("append")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
