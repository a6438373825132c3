"""Set operations on rows, with and without copies.

All but the unions count the copies of each row on both sides in one grouped
pass: a row held by a third of all copies is combined before the shuffle, and
neither side is joined to the other. Nulls equal each other, as in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEFT, _RIGHT, _COPIES = "_left_copies", "_right_copies", "_copies"

# Copies of one row that a single task writes out.
CHUNK = 1_000_000


def _counted(left: DataFrame, right: DataFrame) -> DataFrame:
    columns = left.columns
    tagged = left.withColumn(_LEFT, F.lit(1)).withColumn(_RIGHT, F.lit(0)).unionAll(
        right.toDF(*columns).withColumn(_LEFT, F.lit(0)).withColumn(_RIGHT, F.lit(1))
    )
    return tagged.groupBy(*columns).agg(
        F.sum(_LEFT).alias(_LEFT), F.sum(_RIGHT).alias(_RIGHT)
    )


def _repeated(
    counted: DataFrame, columns: Sequence[str], copies: Column, chunk: int
) -> DataFrame:
    """Each row as often as ``copies`` says; long runs are spread over tasks.

    Chunks are small until they are written out, so their number of partitions is
    given: AQE would put them all in one.
    """
    tasks = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = counted.select(*columns, copies.alias(_COPIES)).where(F.col(_COPIES) > 0)
    few = rows.where(F.col(_COPIES) <= chunk)
    chunks = F.sequence(F.lit(0).cast("bigint"), F.expr(f"({_COPIES} - 1) div {chunk}"))
    many = (
        rows.where(F.col(_COPIES) > chunk)
        .withColumn("_chunk", F.explode(chunks))
        .withColumn(_COPIES, F.least(F.lit(chunk), F.col(_COPIES) - F.col("_chunk") * chunk))
        .repartition(tasks, *columns, "_chunk")
        .drop("_chunk")
    )
    return few.unionAll(many).select(
        *columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(_COPIES))).alias("_copy")
    ).drop("_copy")


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of both sides."""
    return left.unionAll(right)


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of either side, once."""
    return left.unionAll(right).distinct()


def intersect_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that both sides hold, once."""
    both = (F.col(_LEFT) > 0) & (F.col(_RIGHT) > 0)
    return _counted(left, right).where(both).select(*left.columns)


def except_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that ``right`` does not hold, once."""
    only = (F.col(_LEFT) > 0) & (F.col(_RIGHT) == 0)
    return _counted(left, right).where(only).select(*left.columns)


def intersect_all(left: DataFrame, right: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows that both sides hold, as often as the side with fewer copies."""
    copies = F.least(_LEFT, _RIGHT)
    return _repeated(_counted(left, right), left.columns, copies, chunk)


def except_all(left: DataFrame, right: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``left``, less one copy for each copy in ``right``."""
    copies = F.col(_LEFT) - F.col(_RIGHT)
    return _repeated(_counted(left, right), left.columns, copies, chunk)
