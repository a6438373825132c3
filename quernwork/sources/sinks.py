"""Tables written once by a key, so that later work on the key needs no shuffle or reads less."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernwork.sources.shared import new_folder


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int, table: str | None = None) -> DataFrame:
    """``df`` as a table in ``buckets`` buckets by a hash of ``keys``, sorted by them within.

    Tables of one number of buckets join on these keys, and group by them, without a
    shuffle. Rows are brought together by key first, so each bucket is one file. The files
    lie in the shared folder; the table's name, given or not, is known to the session. All
    rows of a key lie in one bucket: keys that hold much of the rows do not belong here.
    Null keys are kept, in one bucket. Columns keep their names and kinds.
    """
    spark = df.sparkSession
    name = table or f"bucketed_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", new_folder(spark, name)).saveAsTable(name)
    return spark.table(name)


def partitioned(df: DataFrame, by: Sequence[str], files: int = 1) -> str:
    """The folder of ``df`` written with a folder for each value of ``by``.

    Readers that ask for some values list and read only their folders, also where the
    values come out of a join while it runs. Each value has at most ``files`` files, dealt
    by a hash of the row, so that a value with many rows is written by many tasks. Use it for
    columns of few values. Rows whose ``by`` is null have a folder of their own.
    """
    # A number that is given keeps Spark from merging small ones again.
    parts = max(files, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plain = [c for c, t in df.dtypes if "map" not in t and "variant" not in t]
    salt = F.pmod(F.xxhash64(*plain), F.lit(files))
    path = new_folder(df.sparkSession, "partitioned")
    df.repartition(parts, *by, salt).write.partitionBy(*by).parquet(path)
    return path


def dropped(spark: SparkSession, table: str) -> None:
    """Forget a table; its files stay for the owner of the shared folder."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
