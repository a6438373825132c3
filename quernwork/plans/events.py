"""Event properties, event-time windows and as-of matches, in batch."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernwork.functions import Measure, amount, cents, count, highest, lowest, partials, total
from quernwork.operators import asof_within, sessions, sliding, tumbling
from quernwork.operators.skew import HOT_ROWS
from quernwork.plans.registry import Query
from quernwork.sources import Tables

GAP = timedelta(minutes=30)


def values() -> list[Measure]:
    return [count("n_events"), total("value", cents("value"))]


def with_double_value(df: DataFrame) -> DataFrame:
    return df.withColumn("sum_value", amount("value")).drop("value_high", "value_low")


def props_by_type(tables: Tables) -> DataFrame:
    """The number ``k`` in each event's properties, by event type; what is none counts as null."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    events = tables.read("events", "event_type", "props").select("event_type", k.alias("k"))
    return events.groupBy("event_type").agg(
        F.count("k").alias("n_k"),
        F.sum("k").alias("sum_k"),
        F.min("k").alias("min_k"),
        F.max("k").alias("max_k"),
        F.avg("k").alias("avg_k"),
        F.count_distinct("k").alias("distinct_k"),
    )


_PROPS_BY_TYPE_SQL = """
SELECT event_type, count(k) AS n_k, CAST(sum(k) AS BIGINT) AS sum_k, min(k) AS min_k, max(k) AS max_k,
       avg(k) AS avg_k, count(DISTINCT k) AS distinct_k
FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
GROUP BY event_type
"""


def value_by_props(tables: Tables) -> DataFrame:
    """Event values by decade of the number ``k`` in the properties."""
    fields = F.from_json("props", "k bigint")
    events = tables.read("events", "props", "value").select(fields["k"].alias("k"), "value")
    decades = events.groupBy(F.expr("k div 10").alias("decade")).agg(*partials(values()))
    return with_double_value(decades)


_VALUE_BY_PROPS_SQL = """
SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS decade, count(*) AS n_events,
       CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS sum_value
FROM events
GROUP BY decade
"""


def events_per_day(tables: Tables) -> DataFrame:
    events = tables.read("events", "ts", "event_type", "value")
    return with_double_value(tumbling(events, ["event_type"], "ts", timedelta(days=1), values()))


EVENTS_PER_DAY_SQL = """
SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start,
       time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, count(*) AS n_events,
       CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS sum_value
FROM events
GROUP BY ALL
"""


def events_sliding(tables: Tables) -> DataFrame:
    events = tables.read("events", "ts", "event_type", "value")
    width, slide = timedelta(hours=6), timedelta(hours=2)
    return with_double_value(sliding(events, ["event_type"], "ts", width, slide, values()))


EVENTS_SLIDING_SQL = """
SELECT event_type, window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS n_events,
       CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS sum_value
FROM (
  SELECT event_type, value,
         unnest([time_bucket(INTERVAL 2 HOUR, ts) - back * INTERVAL 2 HOUR FOR back IN [0, 1, 2]])
           AS window_start
  FROM events
)
GROUP BY ALL
"""


def user_sessions(tables: Tables, hot_rows: int = HOT_ROWS) -> DataFrame:
    events = tables.read("events", "ts", "user_id", "value")
    measures = [*values(), lowest("min_value", "value"), highest("max_value", "value")]
    return with_double_value(sessions(events, ["user_id"], "ts", GAP, measures, hot_rows))


def _sessions_sql(more: str = "") -> str:
    return f"""
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
       count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS sum_value{more}
FROM (
  SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS session
  FROM (
    SELECT user_id, ts, value,
           coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true)
             AS starts
    FROM events
  )
)
GROUP BY user_id, session
"""


USER_SESSIONS_SQL = _sessions_sql()
_USER_SESSIONS_SQL = _sessions_sql(", min(value) AS min_value, max(value) AS max_value")


def event_before_purchase(tables: Tables, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each purchase with the latest earlier event of its user that was none."""
    bought = F.col("event_type") == "purchase"
    return asof_within(
        tables.read("events", "event_id", "ts", "user_id", "event_type", "value"),
        is_left=bought,
        is_right=~bought,
        columns=["event_id", "ts", "user_id", "value"],
        by=["user_id"],
        time="ts",
        take={"before_ts": "ts", "before_id": "event_id", "before_type": "event_type"},
        spread=["event_id"],
        allow_equal=False,
        hot_rows=hot_rows,
    )


_EVENT_BEFORE_PURCHASE_SQL = """
SELECT p.event_id, p.ts, p.user_id, p.value,
       e.ts AS before_ts, e.event_id AS before_id, e.event_type AS before_type
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase') e
ON p.user_id = e.user_id AND p.ts > e.ts
"""

QUERIES = {
    "props_by_type": Query(props_by_type, _PROPS_BY_TYPE_SQL),
    "value_by_props": Query(value_by_props, _VALUE_BY_PROPS_SQL),
    "events_per_day": Query(events_per_day, EVENTS_PER_DAY_SQL),
    "events_sliding": Query(events_sliding, EVENTS_SLIDING_SQL),
    "user_sessions": Query(user_sessions, _USER_SESSIONS_SQL),
    "event_before_purchase": Query(event_before_purchase, _EVENT_BEFORE_PURCHASE_SQL),
}
