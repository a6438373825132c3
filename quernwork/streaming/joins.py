"""Joining two streams by key and time, with state that watermarks keep bounded."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernwork.functions.times import micros


def following(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    left_time: str,
    right_time: str,
    within: timedelta,
    how: str = "inner",
) -> DataFrame:
    """Rows of ``left`` with those of ``right`` that follow in no more than ``within``.

    A pair agrees in ``on``, and its right time is from the left time to ``within`` after
    it, both ends included. Both streams have a watermark on their time
    (``with_event_time``). Spark keeps a left row until the right watermark is ``within``
    past it, and a right row until the left watermark has reached it; so state is bounded
    by that stretch of time and not by the streams. Rows behind their watermark when they
    come are late and are left out. ``how`` is ``inner``, or ``leftOuter``, where a left row
    without a partner comes out once none can come any more.

    Column names of the sides must differ. Nulls in keys or times match nothing.
    """
    if how not in ("inner", "leftOuter"):
        raise ValueError(f"{how} is neither inner nor leftOuter")
    same = [F.col(one) == F.col(other) for one, other in on]
    return left.join(right, [*same, in_time(left_time, right_time, within)], how)


def in_time(left_time: str, right_time: str, within: timedelta) -> Column:
    """Whether the right time follows the left one in no more than ``within``."""
    last = F.col(left_time) + F.expr(f"INTERVAL {micros(within)}")
    return (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= last)
