"""Event-time windows over a table: fixed, sliding, and by gaps in activity."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernwork.functions.measures import Measure, columns, merges, partials
from quernwork.functions.times import micros
from quernwork.operators.skew import HOT_ROWS, part_heavy

_MICROSECOND = timedelta(microseconds=1)

# Panes of one key that the first step of a session search puts in one group.
PANES_PER_BLOCK = 4096


def tumbling(
    df: DataFrame,
    by: Sequence[str],
    time: str,
    width: timedelta,
    measures: Sequence[Measure],
) -> DataFrame:
    """Measures per window of ``width``; each row lies in one."""
    grouped = df.groupBy(*by, F.window(time, micros(width))).agg(*partials(measures))
    return _flat(grouped, by, measures)


def sliding(
    df: DataFrame,
    by: Sequence[str],
    time: str,
    width: timedelta,
    slide: timedelta,
    measures: Sequence[Measure],
) -> DataFrame:
    """Measures per window of ``width``, one starting every ``slide``.

    A row lies in several windows. Rows are first aggregated into panes, the
    widest that divide both ``width`` and ``slide``, and only the panes are
    copied into their windows.
    """
    pane = gcd(width // _MICROSECOND, slide // _MICROSECOND) * _MICROSECOND
    panes = (
        df.groupBy(*by, F.window(time, micros(pane)).alias("_pane"))
        .agg(*partials(measures))
        .withColumn("_pane", F.col("_pane.start"))
    )
    windows = F.window("_pane", micros(width), micros(slide)).alias("window")
    return _flat(panes.groupBy(*by, windows).agg(*merges(measures)), by, measures)


def _flat(df: DataFrame, by: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    return df.select(
        *by,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *columns(measures),
    )


def sessions(
    df: DataFrame,
    by: Sequence[str],
    time: str,
    gap: timedelta,
    measures: Sequence[Measure],
    hot_rows: int = HOT_ROWS,
    panes_per_block: int = PANES_PER_BLOCK,
) -> DataFrame:
    """Measures per session: rows of one key no more than ``gap`` apart.

    A session runs from its first row to ``gap`` after its last. This is Spark's
    ``session_window``, which brings all rows of a key to one task; keys of more
    than ``hot_rows`` rows, found by a first look at the keys alone, take another
    way to the same result.
    """
    dated = df.where(F.col(time).isNotNull())
    rest, hot = part_heavy(dated, by, hot_rows)
    window = F.session_window(time, micros(gap)).alias("_session")
    # Spark joins up sessions only where it aggregates something. A filter on a count keeps
    # that so when a later step, such as distinct, needs no measure.
    grouped = rest.groupBy(*by, window).agg(F.count(F.lit(1)).alias("_rows"), *partials(measures))
    found = grouped.where("_rows > 0").select(
        *by,
        F.col("_session.start").alias("session_start"),
        F.col("_session.end").alias("session_end"),
        *columns(measures),
    )
    if hot is None:
        return found
    return found.unionByName(_hot_sessions(hot, by, time, gap, measures, panes_per_block))


def _hot_sessions(
    df: DataFrame,
    by: Sequence[str],
    time: str,
    gap: timedelta,
    measures: Sequence[Measure],
    panes_per_block: int,
) -> DataFrame:
    """Sessions in three steps, none of which gathers the rows of a key.

    1. Rows within a pane as wide as the gap always share a session. They are
       aggregated, with the combining before the shuffle that this brings.
    2. Panes are joined up within blocks of a fixed number of panes: no group has
       more rows than that, however many events it holds.
    3. Only sessions that reach within a gap of a block's edge can go on in
       another block. Those, at most two a block, are joined up per key.

    Whether a session is at an edge comes out of the grouping of step 2, so that
    Spark pushes no filter below it and both its uses read the same shuffled panes.
    """
    pane = F.window(time, micros(gap)).alias("_pane")
    starts_at_edge = F.col("_first") < F.col("_block.start") + gap
    ends_at_edge = F.col("_last") >= F.col("_block.end") - gap
    panes = (
        df.groupBy(*by, pane)
        .agg(F.min(time).alias("_first"), F.max(time).alias("_last"), *partials(measures))
        .withColumn("_block", F.window("_pane.start", micros(gap * panes_per_block)))
        .withColumn("_at_edge", starts_at_edge | ends_at_edge)
        .drop("_pane")
    )
    merged = merges(measures)
    at_edge = F.bool_or("_at_edge").alias("_at_edge")
    in_block = _join_up(panes, [*by, "_block"], gap, [*merged, at_edge]).drop("_block")
    settled = in_block.where(~F.col("_at_edge")).drop("_at_edge")
    across = _join_up(in_block.where("_at_edge"), by, gap, merged)
    return settled.unionByName(across).select(
        *by,
        F.col("_first").alias("session_start"),
        (F.col("_last") + gap).alias("session_end"),
        *columns(measures),
    )


def _join_up(
    df: DataFrame, by: Sequence[str], gap: timedelta, merged: Sequence[Column]
) -> DataFrame:
    """Merge the stretches of activity of a key that follow each other within ``gap``."""
    window = Window.partitionBy(*by).orderBy("_first")
    starts = F.col("_first") > F.lag("_last").over(window) + gap
    numbered = df.withColumn("_starts", F.coalesce(starts, F.lit(False)).cast("int")).withColumn(
        "_number", F.sum("_starts").over(window)
    )
    return (
        numbered.groupBy(*by, "_number")
        .agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), *merged)
        .drop("_number")
    )
