"""The first rows of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Above this many rows a group is ranked in pieces first. Spark's own limit on what a
# map task sends of a group ends at a setting; this does not depend on it.
FEW = 100
# Pieces of a group, and of those pieces in the second of three steps.
PIECES = 1024


def top_k(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
) -> DataFrame:
    """The first ``k`` rows of each group by ``order``, numbered from 1.

    ``order`` should leave no ties, or the choice between tied rows is open. Groups may
    be of any size. For a small ``k``, filtering on ``row_number`` lets Spark keep the
    best ``k`` of each group in every map task. For a larger one groups are first cut
    into pieces by a hash of the row and only the best ``k`` of each piece go on, in
    two steps, so that the last holds some ``k`` times the square root of the pieces.
    Both ways give the same rows. Columns keep their names and values, whatever they are
    called; ``rank`` must not be one of them.
    """
    if k > FEW:
        salt, names = _free("_piece", df.columns), df.columns
        piece = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map" not in t and "variant" not in t]), F.lit(PIECES))
        df = df.withColumn(salt, piece)
        for width in (1, int(PIECES**0.5)):
            df = df.withColumn(salt, F.floor(F.col(salt) / width))
            df = _best(df, [*by, salt], order, k, rank).drop(rank)
        df = df.select(*[f"`{name}`" for name in names])
    return _best(df, by, order, k, rank)


def _free(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores in front until no column is called so."""
    used = {column.lower() for column in taken}
    while name in used:
        name = f"_{name}"
    return name


def _best(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
