"""Sums over order lines, alone and along the star of dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernwork.functions import (
    Measure,
    amount,
    cents,
    count,
    discounted,
    partials,
    taxed,
    total,
)
from quernwork.operators import roll_up
from quernwork.operators.skew import BROADCAST_VALUES, may_broadcast
from quernwork.plans.registry import Query
from quernwork.sources import Tables


def _revenue() -> list[Measure]:
    return [count("n_lines"), total("revenue", discounted("l_extendedprice", "l_discount"))]


def pricing_summary(tables: Tables) -> DataFrame:
    shipped = F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz")
    sums = (
        tables.read("lineitem")
        .where(shipped)
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            *partials(
                [
                    count("n_lines"),
                    total("quantity", cents("l_quantity")),
                    total("base", cents("l_extendedprice")),
                    total("discounted", discounted("l_extendedprice", "l_discount")),
                    total("charged", taxed("l_extendedprice", "l_discount", "l_tax")),
                    total("discount", cents("l_discount")),
                ]
            )
        )
    )
    return sums.select(
        "l_returnflag",
        "l_linestatus",
        amount("quantity").alias("sum_qty"),
        amount("base").alias("sum_base_price"),
        amount("discounted", 4).alias("sum_disc_price"),
        amount("charged", 6).alias("sum_charge"),
        (amount("quantity") / F.col("n_lines")).alias("avg_qty"),
        (amount("base") / F.col("n_lines")).alias("avg_price"),
        (amount("discount") / F.col("n_lines")).alias("avg_disc"),
        "n_lines",
    ).orderBy("l_returnflag", "l_linestatus")


_PRICING_SUMMARY_SQL = """
SELECT l_returnflag, l_linestatus,
       CAST(CAST(quantity AS DECIMAL(38,2)) AS DOUBLE) AS sum_qty,
       CAST(CAST(base AS DECIMAL(38,2)) AS DOUBLE) AS sum_base_price,
       CAST(CAST(discounted AS DECIMAL(38,2)) AS DOUBLE) AS sum_disc_price,
       CAST(CAST(charged AS DECIMAL(38,2)) AS DOUBLE) AS sum_charge,
       CAST(quantity AS DOUBLE) / n_lines AS avg_qty,
       CAST(base AS DOUBLE) / n_lines AS avg_price,
       CAST(discount AS DOUBLE) / n_lines AS avg_disc,
       n_lines
FROM (
  SELECT l_returnflag, l_linestatus,
         sum(CAST(l_quantity AS DECIMAL(12,2))) AS quantity,
         sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS base,
         sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS discounted,
         sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
             * (1 + CAST(l_tax AS DECIMAL(4,2)))) AS charged,
         sum(CAST(l_discount AS DECIMAL(4,2))) AS discount,
         count(*) AS n_lines
  FROM lineitem
  WHERE l_shipdate <= TIMESTAMP '2001-06-01'
  GROUP BY l_returnflag, l_linestatus
)
ORDER BY l_returnflag, l_linestatus
"""


def revenue_by_region(tables: Tables) -> DataFrame:
    """Revenue by region: sums climb from lines to orders, customers and nations."""
    lines = tables.read("lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    by_order = lines.groupBy("l_orderkey").agg(*partials(_revenue()))
    orders = tables.read("orders", "o_orderkey", "o_custkey")
    by_customer = roll_up(by_order, orders, ("l_orderkey", "o_orderkey"), ["o_custkey"], _revenue())
    customers = tables.read("customer", "c_custkey", "c_nationkey")
    by_nation = roll_up(by_customer, customers, ("o_custkey", "c_custkey"), ["c_nationkey"], _revenue())
    places = tables.read("nation", "n_nationkey", "n_regionkey").join(
        tables.read("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    by_region = roll_up(by_nation, places, ("c_nationkey", "n_nationkey"), ["r_name"], _revenue())
    return by_region.select("r_name", "n_lines", amount("revenue", 4).alias("revenue")).orderBy("r_name")


_REVENUE_BY_REGION_SQL = """
SELECT r_name, count(*) AS n_lines,
       CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))
            AS DECIMAL(38,2)) AS DOUBLE) AS revenue
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name
ORDER BY r_name
"""


def revenue_by_brand_and_year(tables: Tables) -> DataFrame:
    lines = tables.read("lineitem", "l_partkey", "l_shipdate", "l_extendedprice", "l_discount")
    year = F.year("l_shipdate").alias("ship_year")
    by_part = lines.groupBy("l_partkey", year).agg(*partials(_revenue()))
    parts = tables.read("part", "p_partkey", "p_brand")
    by_brand = roll_up(by_part, parts, ("l_partkey", "p_partkey"), ["p_brand", "ship_year"], _revenue())
    return by_brand.select("p_brand", "ship_year", "n_lines", amount("revenue", 4).alias("revenue"))


_REVENUE_BY_BRAND_AND_YEAR_SQL = """
SELECT p_brand, CAST(year(l_shipdate) AS INTEGER) AS ship_year, count(*) AS n_lines,
       CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))
            AS DECIMAL(38,2)) AS DOUBLE) AS revenue
FROM lineitem
JOIN part ON l_partkey = p_partkey
GROUP BY ALL
"""


def revenue_from_local_suppliers(tables: Tables, listed: int = BROADCAST_VALUES) -> DataFrame:
    """Revenue by nation, of lines whose supplier and customer share the nation.

    Orders, fewer than lines, are brought to their nation first. Up to ``listed``
    suppliers, counted, are broadcast, so that lines know their supplier's nation before
    their one join as rows, and leave it as a sum per nation. With more suppliers, or
    broadcasts switched off, lines leave the join as sums per supplier and nation, which
    are hardly fewer than the lines and are shuffled again.
    """
    orders = tables.read("orders", "o_orderkey", "o_custkey")
    customers = tables.read("customer", "c_custkey", "c_nationkey").where("c_nationkey IS NOT NULL")
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = tables.read("lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    suppliers = tables.read("supplier", "s_suppkey", "s_nationkey")
    ordered, supplied = F.col("l_orderkey") == F.col("o_orderkey"), F.col("l_suppkey") == F.col("s_suppkey")
    here = F.col("c_nationkey") == F.col("s_nationkey")
    if may_broadcast(tables.spark) and suppliers.count() <= listed:
        known = lines.where("l_suppkey IS NOT NULL").join(F.broadcast(suppliers), supplied, "left")
        priced = known.join(placed, ordered).select(
            "c_nationkey", here.alias("local"), discounted("l_extendedprice", "l_discount").alias("units")
        )
        # All prices are looked at, as wrong ones are an error whoever supplies.
        units = F.when(F.col("units").isNotNull() & F.col("local"), F.col("units"))
        by_nation = (
            priced.groupBy("c_nationkey")
            .agg(F.count_if("local").alias("n_lines"), *partials([total("revenue", units)]))
            .where("n_lines > 0")
        )
    else:
        by_supplier = lines.join(placed, ordered).groupBy("l_suppkey", "c_nationkey").agg(*partials(_revenue()))
        by_nation = roll_up(by_supplier, suppliers, supplied & here, ["c_nationkey"], _revenue())
    nations = tables.read("nation", "n_nationkey", "n_name")
    named = roll_up(by_nation, nations, ("c_nationkey", "n_nationkey"), ["n_name"], _revenue())
    return named.select("n_name", "n_lines", amount("revenue", 4).alias("revenue"))


_REVENUE_FROM_LOCAL_SUPPLIERS_SQL = """
SELECT n_name, count(*) AS n_lines,
       CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))
            AS DECIMAL(38,2)) AS DOUBLE) AS revenue
FROM lineitem
JOIN supplier ON l_suppkey = s_suppkey
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey AND s_nationkey = c_nationkey
JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name
"""

QUERIES = {
    "pricing_summary": Query(pricing_summary, _PRICING_SUMMARY_SQL),
    "revenue_by_region": Query(revenue_by_region, _REVENUE_BY_REGION_SQL),
    "revenue_by_brand_and_year": Query(revenue_by_brand_and_year, _REVENUE_BY_BRAND_AND_YEAR_SQL),
    "revenue_from_local_suppliers": Query(
        revenue_from_local_suppliers, _REVENUE_FROM_LOCAL_SUPPLIERS_SQL
    ),
}
