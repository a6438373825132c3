"""As-of join: to each row, the latest row of another table at its time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernwork.functions.times import ticks
from quernwork.operators.skew import HOT_ROWS, Pieces, broadcast_up_to, cut_hot_keys

# Parts over which left rows without a key or a time are spread; they match nothing.
LOOSE_PARTS = 1 << 20


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    take: Mapping[str, str],
    spread: Sequence[str],
    allow_equal: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every row of ``left`` with columns of the latest row of ``right`` at its time.

    Rows match on ``by``; the time of the match is no later than ``left_time``, or
    before it when ``allow_equal`` is false. ``take`` maps new column names to columns
    of ``right``; they are null where nothing matches. Of right rows with one key and
    time the one greatest in the taken columns is used. ``spread`` names columns that
    tell left rows of one key and time apart.

    Both tables are laid in one time line per key, and each left row takes the last
    right row before it: one shuffle and no pairs. A key with more than ``hot_rows``
    rows is cut into pieces of its time line, and each piece starts with the last right
    row of the pieces before it. To find such keys both tables are read once more, and
    again if there are any: write costly inputs out first.
    """
    lefts = _lefts(left, left.columns, by, left_time, F.lit(True))
    rights = _rights(right, by, right_time, take, F.lit(True))
    laid = lefts.unionByName(rights.where(_present([*by, "_tick"])), allowMissingColumns=True)
    return _matched(laid, by, take, spread, allow_equal, hot_rows)


def asof_within(
    df: DataFrame,
    is_left: Column,
    is_right: Column,
    columns: Sequence[str],
    by: Sequence[str],
    time: str,
    take: Mapping[str, str],
    spread: Sequence[str],
    allow_equal: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``asof_join`` of two parts of one table, which is read once for both.

    Rows where ``is_left`` holds are kept with ``columns``; those where ``is_right``
    holds are what they take from. A row may be both.
    """
    taken = F.struct(*[F.col(column).alias(name) for name, column in take.items()])
    usable = is_right & _present([*by, time])
    laid = df.where(is_left | usable).select(
        *by,
        ticks(df, time).alias("_tick"),
        F.when(is_left, F.struct(*columns)).alias("_left"),
        F.when(usable, taken).alias("_right"),
    )
    return _matched(laid, by, take, spread, allow_equal, hot_rows)


def _present(columns: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def _lefts(df: DataFrame, columns: Sequence[str], by: Sequence[str], time: str, where: Column) -> DataFrame:
    return df.where(where).select(*by, ticks(df, time).alias("_tick"), F.struct(*columns).alias("_left"))


def _rights(df: DataFrame, by: Sequence[str], time: str, take: Mapping[str, str], where: Column) -> DataFrame:
    taken = [F.col(column).alias(name) for name, column in take.items()]
    return df.where(where).select(*by, ticks(df, time).alias("_tick"), F.struct(*taken).alias("_right"))


def _matched(
    laid: DataFrame, by: Sequence[str], take: Mapping[str, str], spread: Sequence[str], allow_equal: bool, hot_rows: int
) -> DataFrame:
    mark = F.when(F.col("_right").isNotNull(), F.col("_tick")).alias("_mark")
    known = laid.where(_present([*by, "_tick"]))
    cut = cut_hot_keys(known.select(*by, "_tick", mark), by, "_tick", "_mark", hot_rows)
    salt = F.xxhash64(*[F.col(f"_left.{c}") for c in spread])
    loose = F.when(~_present([*by, "_tick"]), -1 - F.pmod(salt, F.lit(LOOSE_PARTS)))
    if cut is None:
        pieces = laid.select("*", F.lit(0).alias("_piece"), F.coalesce(loose, F.lit(0)).alias("_part"))
    else:
        pieces = _in_pieces(laid, cut, by, salt, loose, allow_equal, hot_rows)
    found = _last_right(pieces, [*by, "_piece", "_part"], allow_equal)
    return found.select("_left.*", *[f"_found.{name}" for name in take])


def _in_pieces(
    laid: DataFrame, cut: Pieces, by: Sequence[str], salt: Column, loose: Column, allow_equal: bool, hot_rows: int
) -> DataFrame:
    """All rows by piece, with the last right row before each piece, without a tick.

    A single tick of more than ``hot_rows`` rows is a piece of several parts. Its left
    rows are dealt over them; of its right rows, which all stand at one tick, only the
    greatest goes on, to every part. What is broadcast has keys and ticks only.
    """
    parts = F.ceil(F.col("n_rows") / hot_rows).cast("bigint")
    crowded = cut.counts.where(F.col("n_rows") > hot_rows).select(*by, "_piece", parts.alias("_parts"))
    n_crowded = crowded.count()
    placed = cut.place(laid, "_tick", "_piece").withColumn("_piece", F.coalesce("_piece", F.lit(0)))
    placed = placed.join(broadcast_up_to(crowded, n_crowded), [*by, "_piece"], "left")
    part = F.coalesce(loose, F.pmod(salt, F.col("_parts")), F.lit(0))

    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        cut.counts.withColumn("_tick", F.last("mark", ignorenulls=True).over(earlier))
        .where(F.col("_tick").isNotNull())
        .select(*by, "_tick", F.col("_piece").alias("_for"))
    )
    rights = laid.where(F.col("_right").isNotNull()).select(*by, "_tick", "_right")
    starts = (
        rights.join(broadcast_up_to(before, cut.n_counts), [*by, "_tick"])
        .groupBy(*by, F.col("_for").alias("_piece"))
        .agg(F.max("_right").alias("_right"))
        .join(broadcast_up_to(crowded, n_crowded), [*by, "_piece"], "left")
    )
    one = F.lit(1).cast("bigint")
    copies = F.explode(F.sequence(one - 1, F.coalesce("_parts", one) - 1))
    added = starts.select(*by, "_piece", "_right", copies.alias("_part"))
    if n_crowded:
        is_left = F.col("_left").isNotNull()
        greatest = (
            placed.where(F.col("_right").isNotNull() & F.col("_parts").isNotNull())
            .groupBy(*by, "_piece", "_parts", "_tick")
            .agg(F.max("_right").alias("_right"))
        )
        added = added.unionByName(
            greatest.select(*by, "_piece", "_tick", "_right", copies.alias("_part")), allowMissingColumns=True
        )
        placed = placed.where(is_left | F.col("_parts").isNull()).withColumn(
            "_right", F.when(F.col("_parts").isNull(), F.col("_right"))
        )
    own = placed.select(*by, "_tick", "_left", "_right", "_piece", part.alias("_part"))
    return own.unionByName(added, allowMissingColumns=True)


def _last_right(pieces: DataFrame, within: Sequence[str], allow_equal: bool) -> DataFrame:
    """Left rows with the last right row before them; a row that is both is a right row too."""
    is_left = F.col("_left").isNotNull()
    order = [F.col("_tick").asc_nulls_first()]
    timeline = Window.partitionBy(*within)
    greatest = F.struct("_tick", "_right")
    seen = F.max(F.when(F.col("_right").isNotNull(), greatest))
    if allow_equal:
        upto = seen.over(timeline.orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    else:
        upto = seen.over(timeline.orderBy(*order).rangeBetween(Window.unboundedPreceding, -1))
    return pieces.withColumn("_seen", upto).where(is_left).withColumn("_found", F.col("_seen._right"))
