"""Joining rows whose stretches of time, or of whole numbers, overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernwork.functions.times import ticks
from quernwork.operators.skew import HOT_ROWS, broadcast_up_to, heavy_keys
from quernwork.sources.shared import ensure_checkpoint_dir

Span = tuple[str, str | None]


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_span: Span,
    right_span: Span,
    width: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Pairs of rows that agree in ``by`` and whose spans overlap.

    A span is a start and an end, two columns, the end not included; or a time alone,
    ``(time, None)``, which overlaps what holds it. Times are timestamps, dates or whole
    numbers, all four of one kind. Nulls overlap nothing, nor do spans that end where they
    start or before; rows that are alike pair each on their own. An empty side gives no rows.

    The line is cut into bins of ``width`` ticks (microseconds, days or ones), and rows
    meet in a shuffle by bin. A span longer than a bin goes to bins twice, four times and
    so on as wide, so that each lies in two or three of its own size, however long it is;
    it also meets there what is shorter. A pair is counted in one bin only: of the wider
    size, where the later of the two starts. Which sizes there are is looked up first, at
    most 64 numbers; a side goes to no size that the other does not have.

    A bin of more than ``hot_rows`` rows of a side is dealt to pieces, and the other
    side's rows of that bin go to each of them. So no task sees a hot key or time as a
    whole, and no row or pair is dropped. These bins are counted by a first look at keys
    and times alone.

    Gives the columns of ``left`` and those of ``right`` but ``by``; other names must differ.
    """
    names = [*left.columns, *(c for c in right.columns if c not in by)]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"both sides have columns of one name: {names}")
    sides = [_Side("l", left, by, left_span), _Side("r", right, by, right_span)]
    levels = [s.levels(width) for s in sides]
    offered = [s.offered(width, levels[1 - i]) for i, s in enumerate(sides)]
    key = [*(f"_k{i}" for i in range(len(by))), "_level", "_bin"]
    ensure_checkpoint_dir(left.sparkSession)
    heavy = [heavy_keys(o, key, hot_rows).checkpoint() for o in offered]
    if any(not h.isEmpty() for h in heavy):
        offered, key = _dealt(offered, heavy, key, hot_rows), [*key, "_pl", "_pr"]
    one, other = offered
    same = (F.col("_level") == F.greatest("l_level", "r_level")) & (F.col("_bin") == F.greatest("l_first", "r_first"))
    overlap = (F.col("l_from") < F.col("r_to")) & (F.col("r_from") < F.col("l_to"))
    found = one.join(other, key).where(same & overlap)
    out = [F.col(f"l{i}").alias(c) for i, c in enumerate(left.columns)]
    return found.select(*out, *[F.col(f"r{i}").alias(c) for i, c in enumerate(right.columns) if c not in by])


class _Side:
    """One side, its columns called by their places, with its keys, and its span in ticks."""

    def __init__(self, name: str, df: DataFrame, by: Sequence[str], span: Span) -> None:
        start, end = span
        begin = ticks(df, start)
        stop = begin + 1 if end is None else ticks(df, end)
        keys = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(by)]
        columns = [F.col(f"`{c}`").alias(f"{name}{i}") for i, c in enumerate(df.columns)]
        self.name = name
        rows = df.select(*columns, *keys, begin.alias(f"{name}_from"), stop.alias(f"{name}_to"))
        for i in range(len(by)):
            rows = rows.where(F.col(f"_k{i}").isNotNull())
        self.rows = rows.where(F.col(f"{name}_from") < F.col(f"{name}_to"))

    def _level(self, width: int) -> Column:
        """How often the bins are doubled until one is as wide as the span, about."""
        length = F.col(f"{self.name}_to") - F.col(f"{self.name}_from")
        return F.greatest(F.lit(0), F.ceil(F.log2(length / width))).cast("int")

    def levels(self, width: int) -> list[int]:
        found = self.rows.select(self._level(width).alias("level")).distinct().collect()
        return sorted(r["level"] for r in found)

    def offered(self, width: int, others: list[int]) -> DataFrame:
        """Each row in all bins in which it may meet rows of the other side."""
        own, first = f"{self.name}_level", f"{self.name}_first"
        wider = F.filter(F.array(*[F.lit(v) for v in others]).cast("array<int>"), lambda v: v > F.col(own))
        rows = self.rows.withColumn(own, self._level(width))
        rows = rows.withColumn("_level", F.explode(F.concat(F.array(own), wider)))
        rows = rows.withColumn("_size", F.expr(f"shiftleft({width}L, _level)"))
        place = lambda at: F.expr(f"({at} - pmod({at}, _size)) div _size")
        rows = rows.withColumn(first, place(f"{self.name}_from"))
        last = place(f"({self.name}_to - 1)")
        return rows.withColumn("_bin", F.explode(F.sequence(F.col(first), last))).drop("_size")


def _dealt(offered: list[DataFrame], heavy: list[DataFrame], key: list[str], rows: int) -> list[DataFrame]:
    """Both sides with the piece of either that each row of a large bin goes to."""
    pieces = [
        h.select(*key, F.ceil(F.col("n_rows") / rows).cast("int").alias(n)) for h, n in zip(heavy, ("_nl", "_nr"))
    ]
    cut = pieces[0].join(pieces[1], key, "full").fillna(1, ["_nl", "_nr"]).checkpoint()
    listed = broadcast_up_to(cut, cut.count())
    out = []
    for df, own, n_own, other, n_other in zip(offered, ("_pl", "_pr"), ("_nl", "_nr"), ("_pr", "_pl"), ("_nr", "_nl")):
        known = df.join(listed, key, "left").fillna(1, ["_nl", "_nr"])
        hashed = F.xxhash64(*[F.col(c) for c, t in df.dtypes if "map" not in t and "variant" not in t])
        known = known.withColumn(own, F.pmod(hashed, F.col(n_own)).cast("int"))
        known = known.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
        out.append(known.drop("_nl", "_nr"))
    return out
