"""Mixing sources to target weights, within exact budgets of tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernwork.llm.common import durable, free_name

# What counts as a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Hash prefixes cut each source into ranges of keys, which have no more rows than this
# on average; no task sorts more than one range of one source.
RANGE_ROWS = 256


def words(text: Column) -> Column:
    """How many words ``text`` has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def random_key(*columns: Column) -> Column:
    """A hash of ``columns`` that orders rows at random, the same in every run.

    Nulls differ from empty texts.
    """
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws(":", *parts))


def targets(
    totals: DataFrame, source: str, size: str, weights: Sequence[int], share: float, repeats: int
) -> DataFrame:
    """The target of every source, from one row per source with its total size.

    Sources in order of their code points, null last, take ``weights`` in turn.
    ``share`` times all sizes is dealt out by weight; a source's target stops at
    ``repeats`` times its size, and what that leaves over goes to the others by
    weight until none is above. Each round is one aggregate over the sources, and
    stops at least one more of them.

    Sources are numbered in one task, which sees a row for each source and no more.
    Adds ``weight`` and ``target``.
    """
    n = len(weights)
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % n + 1).cast("int"))
    ranked = durable(totals.withColumn("weight", weight.cast("long")))
    cap = F.col(size) * repeats
    full = F.lit(False)
    stopped = -1
    while True:
        found = ranked.agg(
            F.sum(size).alias("all"),
            F.count_if(full).alias("n"),
            F.sum(F.when(full, cap)).alias("taken"),
            F.sum(F.when(~full, F.col("weight"))).alias("weights"),
        ).first()
        level = (share * (found["all"] or 0) - (found["taken"] or 0)) / (found["weights"] or 1)
        if found["n"] == stopped or not found["weights"]:
            break
        stopped = found["n"]
        full = full | (cap <= F.col("weight") * F.lit(level))
    target = F.when(full, cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return ranked.withColumn("target", target)


def mix(
    rows: DataFrame,
    source: str,
    size: str,
    key: str,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
) -> DataFrame:
    """How much of every row a mix of the sources takes.

    ``key`` holds a hash (``random_key``) by which each source is put in random
    order, as hex digits. A source with budget b, its target rounded, and size s
    is taken b div s times in full; what is left of the budget goes to its rows in
    the order of their keys, cut to the unit: of the row at the cut only the first
    part is taken. So each source gives exactly its budget, and no row more than
    ``repeats`` times its size.

    The running sum is taken in two steps, over ranges of keys and within one
    range, so no task holds a whole source. How many ranges hangs on how many rows. Only the totals of the ranges are
    written and joined back.

    Null sources are a source of their own. Rows of size 0 take nothing; if all
    sizes are 0, so are the targets. An empty table gives no rows. Rows with equal
    keys are ordered by all columns that can be ordered; if they are equal in
    those too, either may come first, which gives the same rows. Other columns are
    kept, and may be called as the helpers here.

    Adds ``source_size``, ``target`` and ``taken``.
    """
    names = rows.columns
    digits = 1
    count = rows.count()
    while count > RANGE_ROWS * 16**digits:
        digits += 1
    sk, prefix, start = (free_name(names, n) for n in ("source_key", "key_range", "range_start"))
    keyed = rows.withColumns(
        {
            # A join key without nulls, and never equal for different sources.
            sk: F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-")),
            prefix: F.substring(key, 1, digits),
        }
    )
    ranges = durable(
        keyed.groupBy(sk, prefix).agg(
            F.sum(size).alias("range_size"), F.first(source).alias("name")
        )
    )
    sources = ranges.groupBy(sk).agg(
        F.sum("range_size").alias("source_size"), F.first("name").alias("name")
    )
    dealt = targets(sources, "name", "source_size", weights, share, repeats)
    before = Window.partitionBy(sk).orderBy(prefix).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranges.withColumn(start, F.coalesce(F.sum("range_size").over(before), F.lit(0)))
        .join(dealt.select(sk, "source_size", "target"), sk)
        .select(sk, prefix, start, "source_size", "target")
    )
    order = [key] + [c for c, t in rows.dtypes if c != key and not t.startswith(("map", "variant"))]
    upto = Window.partitionBy(sk, prefix).orderBy(*order)
    upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    end = F.col(start) + F.sum(size).over(upto)
    rest = budget - whole * F.col("source_size")
    part = F.least(F.col(size), F.greatest(F.lit(0), rest - (end - F.col(size))))
    return (
        keyed.join(starts, [sk, prefix])
        .withColumn("taken", (whole * F.col(size) + part).cast("long"))
        .select(*[F.col(c) for c in names], "source_size", "target", "taken")
    )
