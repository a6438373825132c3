"""Stretches of time that overlap, and what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernwork.functions import count
from quernwork.operators import overlap_join, sessions
from quernwork.operators.skew import HOT_ROWS
from quernwork.plans.events import GAP, USER_SESSIONS_SQL
from quernwork.plans.registry import Query
from quernwork.sources import Tables

_HOUR, _DAY = 3_600_000_000, 86_400_000_000


def errors_in_sessions(tables: Tables, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The sessions of users that hold errors, with how many and the first."""
    events = tables.read("events", "ts", "user_id")
    spans = sessions(events, ["user_id"], "ts", GAP, [count("n_events")], hot_rows).drop("n_events")
    errors = tables.read("events", "ts", "user_id", "event_id", "event_type").where("event_type = 'error'")
    held = overlap_join(
        spans, errors.drop("event_type"), ["user_id"], ("session_start", "session_end"), ("ts", None), _HOUR, hot_rows
    )
    return held.groupBy("user_id", "session_start", "session_end").agg(
        F.count("*").alias("n_errors"), F.min("ts").alias("first_error"), F.min("event_id").alias("least_id")
    )


_ERRORS_IN_SESSIONS_SQL = f"""
SELECT s.user_id, s.session_start, s.session_end, count(*) AS n_errors, min(e.ts) AS first_error,
       min(e.event_id) AS least_id
FROM ({USER_SESSIONS_SQL}) s
JOIN events e ON e.user_id = s.user_id AND e.ts >= s.session_start AND e.ts < s.session_end
WHERE e.event_type = 'error'
GROUP BY ALL
"""


def overlapping_orders(tables: Tables, hot_rows: int = HOT_ROWS) -> DataFrame:
    """For each customer, pairs of orders less than 30 days apart."""
    orders = tables.read("orders", "o_custkey", "o_orderkey", "o_orderdate")
    month = F.expr("o_orderdate + INTERVAL 30 DAYS")
    one = orders.select("o_custkey", F.col("o_orderkey").alias("one"), F.col("o_orderdate").alias("begun"), month.alias("done"))
    other = one.toDF("o_custkey", "other", "other_begun", "other_done")
    pairs = overlap_join(one, other, ["o_custkey"], ("begun", "done"), ("other_begun", "other_done"), 30 * _DAY, hot_rows)
    return pairs.where("one < other").groupBy("o_custkey").agg(F.count("*").alias("n_pairs"))


_OVERLAPPING_ORDERS_SQL = """
SELECT a.o_custkey, count(*) AS n_pairs
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
 AND a.o_orderdate < b.o_orderdate + INTERVAL 30 DAY AND b.o_orderdate < a.o_orderdate + INTERVAL 30 DAY
GROUP BY a.o_custkey
"""

QUERIES = {
    "errors_in_sessions": Query(errors_in_sessions, _ERRORS_IN_SESSIONS_SQL),
    "overlapping_orders": Query(overlapping_orders, _OVERLAPPING_ORDERS_SQL),
}
