"""Subtotals over several groupings of the same rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernwork.functions.measures import Measure, merges, partials


def rollup_sets(dims: Sequence[str]) -> list[list[str]]:
    """All dimensions, then one fewer from the right each time, down to none."""
    return [list(dims[:n]) for n in range(len(dims), -1, -1)]


def cube_sets(dims: Sequence[str]) -> list[list[str]]:
    """Every subset of the dimensions."""
    return [list(s) for n in range(len(dims), -1, -1) for s in combinations(dims, n)]


def grouping_totals(
    df: DataFrame,
    dims: Sequence[str],
    sets: Sequence[Sequence[str]],
    measures: Sequence[Measure],
    level: str = "level",
    grouped: bool = False,
) -> DataFrame:
    """Measures for each set of ``dims`` in ``sets``; ``level`` is the grouping id.

    Grouping sets copy each row once per set. The rows are therefore grouped by
    all dimensions first, and only those groups are copied. Pass ``grouped`` when
    ``df`` already holds such groups.
    """
    fine = df if grouped else df.groupBy(*dims).agg(*partials(measures))
    wanted = [[F.col(d) for d in s] for s in sets]
    return fine.groupingSets(wanted, *dims).agg(
        F.grouping_id().cast("int").alias(level), *merges(measures)
    )
