"""Finding keys too large for one task, and cutting them along a line of whole numbers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernwork.sources.shared import ensure_checkpoint_dir

# Rows of one key that a single task sorts without trouble.
HOT_ROWS = 10_000_000
# Counted keys or split values up to this many are broadcast, some 16 MB; more
# are joined by shuffle.
BROADCAST_VALUES = 1_000_000


def heavy_keys(df: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """Keys with more than ``rows`` rows, and how many as ``n_rows``.

    Of N rows at most N / ``rows`` keys can be here. The count is combined before
    its shuffle and reads no column but the keys.
    """
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > rows)


def heavy_list(df: DataFrame, by: Sequence[str], rows: int) -> tuple[DataFrame, int]:
    """The keys of more than ``rows`` rows, and how many keys that is.

    They are written to the checkpoint folder, to be counted before they are joined.
    """
    ensure_checkpoint_dir(df.sparkSession)
    heavy = heavy_keys(df, by, rows).drop("n_rows").checkpoint()
    return heavy, heavy.count()


def part_heavy(
    df: DataFrame, by: Sequence[str], rows: int
) -> tuple[DataFrame, DataFrame | None]:
    """``df`` without its keys of more than ``rows`` rows, and those keys' rows.

    The second is None if there are no such keys; null is a key like any other.
    """
    heavy, n_heavy = heavy_list(df, by, rows)
    if n_heavy == 0:
        return df, None
    return parted(df, by, broadcast_up_to(heavy, n_heavy))


def parted(df: DataFrame, by: Sequence[str], heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` without the keys in ``heavy``, and with those alone."""
    keys = heavy.toDF(*[f"_heavy_{k}" for k in by])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_heavy_{k}")) for k in by])
    return df.join(keys, same, "left_anti"), df.join(keys, same, "left_semi")


@dataclass(frozen=True)
class Pieces:
    """How the time lines of hot keys are cut, as tables of counted sizes.

    ``levels`` cut ever finer: each names stretches, by key and where they start, and
    the width of the pieces in them. ``counts`` has every piece that holds rows: its
    start, its rows as ``n_rows``, its first and last tick, and the greatest ``mark`` in it.
    """

    by: Sequence[str]
    levels: list[tuple[DataFrame, int]]
    counts: DataFrame
    n_counts: int

    def place(self, df: DataFrame, tick: str, piece: str) -> DataFrame:
        """``df`` with where its piece starts; null for keys that are not cut."""
        for number, (table, size) in enumerate(self.levels):
            on = list(self.by) if number == 0 else [*self.by, piece]
            listed = table.withColumnsRenamed({"_start": "_from" if number == 0 else piece, "_width": "_wide"})
            df = df.join(broadcast_up_to(listed, size), on, "left")
            begin = F.col("_from" if number == 0 else piece)
            steps = F.floor((F.col(tick) - begin) / F.col("_wide"))
            inside = begin + steps * F.col("_wide")
            df = df.withColumn(piece, inside if number == 0 else F.coalesce(inside, F.col(piece)))
            df = df.drop("_from", "_wide")
        return df


def cut_hot_keys(
    df: DataFrame, by: Sequence[str], tick: str, mark: str, rows: int
) -> Pieces | None:
    """Cut each key of more than ``rows`` rows along ``tick``, a long, into pieces of fewer.

    A key's stretch of ticks is cut into some four times as many even pieces as its
    rows call for. Rows are counted by key and piece, combined before the shuffle, and
    what still has too many is cut again the same way, down to a single tick. So no
    task sees all of a key, there is no limit on pieces, and only a single tick may
    stay above ``rows``. None if no key is so large.

    The tables are written to the checkpoint folder, to be counted before they are
    joined.
    """
    ensure_checkpoint_dir(df.sparkSession)
    heavy = (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(tick).alias("_start"), F.max(tick).alias("_end"))
        .where(F.col("n_rows") > rows)
        .withColumn("_width", _finer(F.col("_end") - F.col("_start") + 1, F.col("n_rows"), rows))
        .select(*by, "_start", "_width")
        .checkpoint()
    )
    n_heavy = heavy.count()
    if n_heavy == 0:
        return None
    keys = heavy.select(*by)
    hot = df.join(broadcast_up_to(keys, n_heavy), list(by), "left_semi")
    cut = Pieces(by, [(heavy, n_heavy)], heavy, 0)
    while True:
        found = cut.place(hot, tick, "_piece").groupBy(*by, "_piece")
        counts = found.agg(
            F.count(F.lit(1)).alias("n_rows"), F.max(mark).alias("mark"), F.min(tick).alias("_low"), F.max(tick).alias("_high")
        ).checkpoint()
        n_counts = counts.count()
        cut = Pieces(by, cut.levels, counts, n_counts)
        large = counts.where((F.col("n_rows") > rows) & (F.col("_high") > F.col("_low")))
        span = F.col("_high") - F.col("_piece") + 1
        finer = large.select(
            *by, F.col("_piece").alias("_start"), _finer(span, F.col("n_rows"), rows).alias("_width")
        ).checkpoint()
        size = finer.count()
        if size == 0:
            return cut
        cut = Pieces(by, [*cut.levels, (finer, size)], counts, n_counts)


def _finer(span: Column, n_rows: Column, rows: int) -> Column:
    """The width of pieces, four times as many as ``n_rows`` calls for, two at least."""
    return F.greatest(F.lit(1), F.ceil(span / (4 * F.ceil(n_rows / rows)))).cast("bigint")


def broadcast_up_to(df: DataFrame, size: int, limit: int = BROADCAST_VALUES) -> DataFrame:
    """``df`` marked for broadcast if its measured ``size`` allows it, or as it was."""
    return F.broadcast(df) if size <= limit else df


def may_broadcast(spark: SparkSession) -> bool:
    """Whether the session lets tables be broadcast; a negative threshold switches that off."""
    return not spark.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")
