"""Intervals and places on a time line."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(width: timedelta) -> str:
    """A duration in the form Spark's window functions take."""
    return f"{width // timedelta(microseconds=1)} microseconds"


def ticks(df: DataFrame, time: str) -> Column:
    """A time as a long that grows with it: microseconds, or days of a date."""
    kind = dict(df.dtypes)[time]
    if kind == "timestamp":
        return F.unix_micros(time)
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(kind), F.col(time))
    if kind == "date":
        return F.unix_date(time).cast("bigint")
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return F.col(time).cast("bigint")
    raise TypeError(f"{time} is a {kind}, not a time or a whole number")
