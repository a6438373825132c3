"""Stream-stream joins against batch, with late rows."""

from datetime import timedelta

import pytest

from quernwork import streaming
from tests.fixtures import EVENT_SCHEMA, at, events, frame, sorted_rows

MINUTE = timedelta(minutes=1)


class Run:
    """Two source folders, fed a file at a time, and the table that their join fills."""

    def __init__(self, spark, folder, how="inner", within=MINUTE):
        self.spark, self.how, self.within = streaming.event_session(spark), how, within
        self.left, self.right, self.table, self.checkpoint = (str(folder / n) for n in ("left", "right", "table", "checkpoint"))
        for side in (self.left, self.right):
            frame(self.spark, []).write.parquet(side)

    def feed(self, side, rows):
        frame(self.spark, rows).coalesce(1).write.mode("append").parquet(side)

    def go(self):
        sides = []
        for path, name in ((self.left, "l"), (self.right, "r")):
            stream = streaming.with_event_time(self.spark.readStream.schema(EVENT_SCHEMA).parquet(path), "ts", MINUTE)
            sides.append(stream.toDF(*(f"{name}_{c}" for c in ("id", "user", "ts", "value"))))
        pairs = streaming.following(*sides, [("l_user", "r_user")], "l_ts", "r_ts", self.within, self.how)
        streaming.run_to_table(pairs.select("l_id", "r_id"), self.table, self.checkpoint)
        return sorted_rows(self.spark.read.parquet(self.table))


def batch(left, right, within=MINUTE):
    return sorted(
        (a[0], b[0]) for a in left for b in right
        if a[1] is not None and a[1] == b[1] and a[2] and b[2] and a[2] <= b[2] <= a[2] + within
    )


def test_equals_batch_whatever_the_triggers(spark, tmp_path):
    run = Run(spark, tmp_path)
    left, right = (sorted(events(s, 150), key=lambda r: (r[2] is None, r[2] or at(0))) for s in (1, 2))
    for i in range(0, 150, 50):
        run.feed(run.left, left[i : i + 50])
        run.feed(run.right, right[i : i + 50])
        run.go()
    assert run.go() == batch(left, right)


def test_late_rows_are_left_out_and_only_those(spark, tmp_path):
    run = Run(spark, tmp_path)
    run.feed(run.left, [(0, 1, at(0), 0.0), (1, 1, at(300), 0.0)])
    run.feed(run.right, [(10, 1, at(30), 0.0), (11, 1, at(320), 0.0)])
    assert run.go() == [(0, 10), (1, 11)]
    # The watermark is at 240 s: what lies before is late, what lies behind is not.
    late = [(2, 1, at(20), 0.0)]
    run.feed(run.left, [*late, (3, 1, at(310), 0.0)])
    run.feed(run.right, [(12, 1, at(305), 0.0), (13, 1, at(25), 0.0)])
    got = run.go()
    assert got == [(0, 10), (1, 11), (1, 12), (3, 11)]
    assert run.go() == got


def test_rows_without_a_partner_come_once_none_can_come(spark, tmp_path):
    run = Run(spark, tmp_path, "leftOuter")
    run.feed(run.left, [(0, 1, at(0), 0.0), (1, 2, at(10), 0.0)])
    run.feed(run.right, [(10, 1, at(30), 0.0)])
    assert run.go() == [(0, 10)]
    run.feed(run.left, [(2, 9, at(1000), 0.0)])
    run.feed(run.right, [(11, 9, at(2000), 0.0)])
    run.go()
    run.feed(run.left, [(3, 9, at(1001), 0.0)])
    run.feed(run.right, [(12, 9, at(2001), 0.0)])
    assert (1, None) in run.go() and (0, None) not in run.go()


def test_nulls_copies_and_names(spark, tmp_path):
    run = Run(spark, tmp_path)
    rows = [(0, None, at(0), 0.0), (1, 1, None, 0.0), (2, 1, at(5), 0.0), (2, 1, at(5), 0.0)]
    run.feed(run.left, rows)
    run.feed(run.right, rows)
    assert run.go() == [(2, 2)] * 4
    with pytest.raises(ValueError, match="neither"):
        streaming.following(None, None, [], "a", "b", MINUTE, "full")
