"""Joins that shuffle aggregates or distinct keys instead of fact rows.

A broadcast is asked for only of lists of hot keys, which are counted. Otherwise Spark
broadcasts a side by itself when its statistics, or under AQE its measured size, stay
below ``spark.sql.autoBroadcastJoinThreshold``, and sorts and merges otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernwork.functions.measures import Measure, merges
from quernwork.operators.skew import HOT_ROWS, broadcast_up_to, heavy_list, parted


def roll_up(
    df: DataFrame,
    dim: DataFrame,
    on: tuple[str, str] | Column,
    to: Sequence[str],
    measures: Sequence[Measure],
) -> DataFrame:
    """Carry partial results over a many-to-one join and group them anew by ``to``.

    ``df`` holds partial results per key, ``on`` names its key and that of
    ``dim``, which must be unique there. As ``df`` arrives grouped, a key that
    holds a large share of the facts is one row here, and the merge after the
    join is again combined before its shuffle.
    """
    condition = F.col(on[0]) == F.col(on[1]) if isinstance(on, tuple) else on
    return df.join(dim, condition).groupBy(*to).agg(*merges(measures))


def _distinct_keys(df: DataFrame, on: tuple[str, str]) -> DataFrame:
    return df.select(F.col(on[1]).alias(on[0])).distinct()


def having(
    df: DataFrame, other: DataFrame, on: tuple[str, str], unique: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``.

    The keys of ``other`` are made distinct before they are shuffled; the join then
    uses that same partitioning. Keys of more than ``hot_rows`` rows of ``df`` are
    found by a first look at the keys alone; their rows are not shuffled, but meet a
    counted list of those that occur in ``other``. ``unique`` says that no key of
    ``df`` has many rows, which spares the look.
    """
    present = df.where(F.col(on[0]).isNotNull())
    keys = _distinct_keys(other, on)
    if unique:
        return present.join(keys, on[0], "left_semi")
    rest, hot = _parts(present, keys, on[0], hot_rows)
    found = rest.join(keys, on[0], "left_semi")
    return found if hot is None else found.unionByName(hot[0].join(hot[1], on[0], "left_semi"))


def lacking(
    df: DataFrame, other: DataFrame, on: tuple[str, str], unique: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``, null keys among them.

    As in ``having``; rows with a null key take part in no join.
    """
    keys = _distinct_keys(other, on)
    if unique:
        return df.join(keys, on[0], "left_anti")
    absent = df.where(F.col(on[0]).isNull())
    rest, hot = _parts(df.where(F.col(on[0]).isNotNull()), keys, on[0], hot_rows)
    found = rest.join(keys, on[0], "left_anti").unionByName(absent)
    return found if hot is None else found.unionByName(hot[0].join(hot[1], on[0], "left_anti"))


def _parts(
    df: DataFrame, keys: DataFrame, key: str, hot_rows: int
) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """Rows of ordinary keys; rows of hot ones with those hot keys that are in ``keys``."""
    heavy, n_heavy = heavy_list(df, [key], hot_rows)
    if n_heavy == 0:
        return df, None
    rest, hot = parted(df, [key], broadcast_up_to(heavy, n_heavy))
    found = keys.join(broadcast_up_to(heavy, n_heavy), key, "left_semi")
    return rest, (hot, broadcast_up_to(found, n_heavy))
