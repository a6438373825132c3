"""The event windows as streams over a finite table: all windows, as in batch.

Those that the watermark passes come out of the stream; those still open when the input
ends are read from its state.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernwork import streaming
from quernwork.plans.events import (
    EVENTS_PER_DAY_SQL,
    EVENTS_SLIDING_SQL,
    GAP,
    USER_SESSIONS_SQL,
    values,
    with_double_value,
)
from quernwork.plans.registry import Query
from quernwork.sources import Tables, new_folder

_DELAY = timedelta(hours=1)


def _streamed(
    windows: Callable[[DataFrame], DataFrame], by: list[str], name: str
) -> Callable[[Tables], DataFrame]:
    """Run the events through ``windows`` as a stream; what came out, and what is open."""

    def run(tables: Tables) -> DataFrame:
        own = Tables(streaming.event_session(tables.spark), tables.root)
        events = streaming.with_event_time(own.stream("events"), "ts", _DELAY)
        folder = new_folder(tables.spark, "stream")
        table, checkpoint = f"{folder}/table", f"{folder}/checkpoint"
        streaming.run_to_table(windows(events), table, checkpoint)
        # Written out, as the zone of times in the state is that of the stream's session.
        opened = streaming.still_open(own.spark, checkpoint, by, name, values())
        opened.write.parquet(f"{folder}/open")
        read = tables.spark.read
        return with_double_value(read.parquet(table).unionByName(read.parquet(f"{folder}/open")))

    return run


def clicks_before_errors(tables: Tables) -> DataFrame:
    """Each click with the errors of its user within ten minutes after, from two streams."""
    own = Tables(streaming.event_session(tables.spark), tables.root)
    sides = []
    for kind, side in (("click", "click"), ("error", "error")):
        events = streaming.with_event_time(own.stream("events"), "ts", _DELAY)
        chosen = events.where(F.col("event_type") == kind)
        names = {"event_id": f"{side}_id", "user_id": f"{side}_user", "ts": f"{side}_ts"}
        sides.append(chosen.select(*[F.col(c).alias(n) for c, n in names.items()]))
    on = [("click_user", "error_user")]
    pairs = streaming.following(*sides, on, "click_ts", "error_ts", timedelta(minutes=10))
    folder = new_folder(tables.spark, "stream")
    streaming.run_to_table(pairs.select("click_user", "click_id", "error_id"), f"{folder}/table", f"{folder}/checkpoint")
    return tables.spark.read.parquet(f"{folder}/table")


_CLICKS_BEFORE_ERRORS_SQL = """
SELECT c.user_id AS click_user, c.event_id AS click_id, e.event_id AS error_id
FROM events c JOIN events e ON c.user_id = e.user_id
 AND e.ts BETWEEN c.ts AND c.ts + INTERVAL 10 MINUTE
WHERE c.event_type = 'click' AND e.event_type = 'error'
"""

QUERIES = {
    "stream_clicks_before_errors": Query(clicks_before_errors, _CLICKS_BEFORE_ERRORS_SQL),
    "stream_events_per_day": Query(
        _streamed(
            lambda events: streaming.tumbling(events, ["event_type"], "ts", timedelta(days=1), values()),
            ["event_type"],
            "window",
        ),
        EVENTS_PER_DAY_SQL,
    ),
    "stream_events_sliding": Query(
        _streamed(
            lambda events: streaming.sliding(
                events, ["event_type"], "ts", timedelta(hours=6), timedelta(hours=2), values()
            ),
            ["event_type"],
            "window",
        ),
        EVENTS_SLIDING_SQL,
    ),
    "stream_user_sessions": Query(
        _streamed(
            lambda events: streaming.sessions(events, ["user_id"], "ts", GAP, values()), ["user_id"], "session"
        ),
        USER_SESSIONS_SQL,
    ),
}
