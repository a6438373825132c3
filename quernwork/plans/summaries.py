"""Sketches beside exact results, JSON of mixed kinds, and joins of tables written by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernwork.functions import (
    amount,
    count,
    discounted,
    distinct_about,
    distinct_estimate,
    field,
    kind,
    merges,
    parsed,
    partials,
    quantile_estimate,
    quantiles_about,
    total,
)
from quernwork.operators import grouping_totals, rollup_sets
from quernwork.plans.registry import Query
from quernwork.sources import Tables, bucketed

# What the sketches promise here, several times their usual error.
_ERROR, _RANK_ERROR = 0.05, 0.02
# Buckets that orders and their lines are written to.
_BUCKETS = 16


def users_about(tables: Tables) -> DataFrame:
    """Users by type and day, type, and in all: exact, and whether the sketch is near.

    Sketches are taken once, by type and day, and carried through the rollup; the exact
    count has to see all users again for each level.
    """
    events = tables.read("events", "ts", "event_type", "user_id").withColumn("day", F.to_date("ts"))
    dims = ["event_type", "day"]
    about = grouping_totals(events, dims, rollup_sets(dims), [distinct_about("users", "user_id")])
    users = events.groupBy(*dims, "user_id").agg(F.lit(1).alias("one"))
    exact = users.groupingSets([[], [F.col("event_type")], [F.col(d) for d in dims]], *dims).agg(
        F.grouping_id().cast("int").alias("level"), F.count_distinct("user_id").alias("n_users")
    )
    same = [F.col(f"e.{d}").eqNullSafe(F.col(f"a.{d}")) for d in [*dims, "level"]]
    near = F.abs(distinct_estimate("users") - F.col("n_users")) <= F.greatest(F.lit(1), _ERROR * F.col("n_users"))
    return exact.alias("e").join(about.alias("a"), same).select("e.event_type", F.col("e.day").cast("timestamp_ntz").alias("day"), "n_users", near.cast("int").alias("near"))


_USERS_ABOUT_SQL = """
SELECT event_type, CAST(day AS TIMESTAMP) AS day, count(DISTINCT user_id) AS n_users, 1 AS near
FROM (SELECT event_type, CAST(ts AS DATE) AS day, user_id FROM events)
GROUP BY ROLLUP (event_type, day)
"""


def price_quantiles_about(tables: Tables) -> DataFrame:
    """How many orders of each priority cost no more than a sketch's median; near half of them.

    Sketches are taken by priority and status and merged by priority.
    """
    orders = tables.read("orders", "o_orderpriority", "o_orderstatus", "o_totalprice")
    measures = [count("n_orders"), quantiles_about("prices", "o_totalprice")]
    fine = orders.groupBy("o_orderpriority", "o_orderstatus").agg(*partials(measures))
    merged = fine.groupBy("o_orderpriority").agg(*merges(measures))
    cuts = merged.select(
        "o_orderpriority", "n_orders", *[quantile_estimate("prices", q).alias(f"q{n}") for n, q in enumerate((0.1, 0.5, 0.9))]
    )
    below = [F.count_if(F.col("o_totalprice") <= F.col(f"q{n}")).alias(f"b{n}") for n in range(3)]
    met = orders.join(cuts, "o_orderpriority").groupBy("o_orderpriority").agg(F.first("n_orders").alias("n_orders"), *below)
    off = [F.abs(F.col(f"b{n}") / F.col("n_orders") - q) <= F.greatest(F.lit(_RANK_ERROR), 1.5 / F.col("n_orders")) for n, q in enumerate((0.1, 0.5, 0.9))]
    return met.select("o_orderpriority", "n_orders", (off[0] & off[1] & off[2]).cast("int").alias("near"))


_PRICE_QUANTILES_ABOUT_SQL = """
SELECT o_orderpriority, count(*) AS n_orders, 1 AS near FROM orders GROUP BY o_orderpriority
"""


def props_by_kind(tables: Tables) -> DataFrame:
    """Events by type and the kind of the field ``k`` of their properties, read as variants."""
    props = parsed("props")
    events = tables.read("events", "event_type", "props").select("event_type", props.alias("props"))
    fields = events.select(
        "event_type",
        F.col("props").isNull().cast("int").alias("bad"),
        kind(F.col("props"), "$.k").alias("kind"),
        field(F.col("props"), "$.k", "bigint").alias("k"),
    )
    return fields.groupBy("event_type", "kind").agg(
        F.count("*").alias("n_events"), F.sum("bad").alias("n_bad"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k")
    )


_PROPS_BY_KIND_SQL = """
SELECT event_type,
       CASE json_type(json_extract(CASE WHEN json_valid(props) THEN props END, '$.k'))
         WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'BIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING'
         WHEN 'BOOLEAN' THEN 'BOOLEAN' WHEN 'NULL' THEN 'VOID' END AS kind,
       count(*) AS n_events, CAST(count(*) FILTER (NOT json_valid(props)) AS BIGINT) AS n_bad,
       CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k,
       max(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS max_k
FROM events
GROUP BY ALL
"""


def revenue_by_priority(tables: Tables) -> DataFrame:
    """Revenue by priority, of orders and lines that are written in buckets by order."""
    lines = tables.read("lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    orders = tables.read("orders", "o_orderkey", "o_orderpriority")
    lines, orders = bucketed(lines, ["l_orderkey"], _BUCKETS), bucketed(orders, ["o_orderkey"], _BUCKETS)
    measures = [count("n_lines"), total("revenue", discounted("l_extendedprice", "l_discount"))]
    by_order = lines.groupBy("l_orderkey").agg(*partials(measures))
    joined = by_order.hint("merge").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    merged = joined.groupBy("o_orderpriority").agg(*merges(measures))
    return merged.select("o_orderpriority", "n_lines", amount("revenue", 4).alias("revenue"))


_REVENUE_BY_PRIORITY_SQL = """
SELECT o_orderpriority, count(*) AS n_lines,
       CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))
            AS DECIMAL(38,2)) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY o_orderpriority
"""

QUERIES = {
    "users_about": Query(users_about, _USERS_ABOUT_SQL),
    "price_quantiles_about": Query(price_quantiles_about, _PRICE_QUANTILES_ABOUT_SQL),
    "props_by_kind": Query(props_by_kind, _PROPS_BY_KIND_SQL),
    "revenue_by_priority": Query(revenue_by_priority, _REVENUE_BY_PRIORITY_SQL),
}
