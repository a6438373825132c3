"""Customer balances with subtotals by region, nation and market segment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernwork.functions import Measure, amount, cents, count, highest, lowest, partials, total
from quernwork.operators import cube_sets, grouping_totals, roll_up, rollup_sets
from quernwork.plans.registry import Query
from quernwork.sources import Tables

_DIMS = ["r_name", "n_name", "c_mktsegment"]
_PICKED_SETS = [["r_name", "c_mktsegment"], ["n_name"], []]


def _measures() -> list[Measure]:
    return [
        count("n_customers"),
        total("balance", cents("c_acctbal")),
        lowest("min_balance", "c_acctbal"),
        highest("max_balance", "c_acctbal"),
    ]


def _balances(sets: Sequence[Sequence[str]]) -> Callable[[Tables], DataFrame]:
    def run(tables: Tables) -> DataFrame:
        measures = _measures()
        customers = tables.read("customer", "c_nationkey", "c_mktsegment", "c_acctbal")
        by_nation = customers.groupBy("c_nationkey", "c_mktsegment").agg(*partials(measures))
        places = tables.read("nation").join(
            tables.read("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        fine = roll_up(by_nation, places, ("c_nationkey", "n_nationkey"), _DIMS, measures)
        totals = grouping_totals(fine, _DIMS, sets, measures, grouped=True)
        return totals.select(
            *_DIMS,
            "level",
            "n_customers",
            amount("balance").alias("sum_balance"),
            (amount("balance") / F.col("n_customers")).alias("avg_balance"),
            "min_balance",
            "max_balance",
        )

    return run


def _balances_sql(grouping: str) -> str:
    return f"""
SELECT r_name, n_name, c_mktsegment,
       CAST(GROUPING(r_name, n_name, c_mktsegment) AS INTEGER) AS level,
       count(*) AS n_customers,
       CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS sum_balance,
       CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS avg_balance,
       min(c_acctbal) AS min_balance, max(c_acctbal) AS max_balance
FROM customer
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
GROUP BY {grouping}
"""


QUERIES = {
    "balance_rollup": Query(
        _balances(rollup_sets(_DIMS)), _balances_sql("ROLLUP (r_name, n_name, c_mktsegment)")
    ),
    "balance_cube": Query(
        _balances(cube_sets(_DIMS)), _balances_sql("CUBE (r_name, n_name, c_mktsegment)")
    ),
    "balance_grouping_sets": Query(
        _balances(_PICKED_SETS), _balances_sql("GROUPING SETS ((r_name, c_mktsegment), (n_name), ())")
    ),
}
