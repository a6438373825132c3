"""The event-time windows over a stream, and running a stream to a table."""

from quernwork.streaming.joins import following, in_time
from quernwork.streaming.jobs import event_session, run_to_table
from quernwork.streaming.windows import sessions, sliding, still_open, tumbling, with_event_time

__all__ = [
    "event_session",
    "following",
    "in_time",
    "run_to_table",
    "sessions",
    "sliding",
    "still_open",
    "tumbling",
    "with_event_time",
]
