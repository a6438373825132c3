"""Batch windows against a walk through the rows and against Spark's own windows."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from quernwork.functions import amount, cents, count, highest, lowest, total
from quernwork.operators import sessions, sliding, tumbling
from tests.fixtures import at, events, frame, sorted_rows

GAP = timedelta(seconds=60)


def measures():
    return [
        count("n"),
        total("sum", cents("value")),
        lowest("low", "value"),
        highest("high", "value"),
    ]


def summed(df):
    return df.withColumn("sum", amount("sum")).drop("sum_high", "sum_low")


def walked(rows, gap):
    found, by_user = [], {}
    for _, user, ts, value in rows:
        if ts is not None:
            by_user.setdefault(user, []).append((ts, value))
    for user, items in by_user.items():
        items.sort()
        run = [items[0]]
        for item in items[1:]:
            if item[0] - run[-1][0] > gap:
                found.append((user, run))
                run = []
            run.append(item)
        found.append((user, run))
    return sorted(
        (
            (
                user,
                run[0][0],
                run[-1][0] + gap,
                len(run),
                min(v for _, v in run),
                max(v for _, v in run),
                round(sum(round(v * 100) for _, v in run) / 100, 2),
            )
            for user, run in found
        ),
        key=lambda r: tuple((v is not None, v) for v in r),
    )


@pytest.mark.parametrize("hot_rows", [0, 60, 10_000])
@pytest.mark.parametrize("panes_per_block", [1, 2, 5, 4096])
def test_sessions_match_walk(spark, panes_per_block, hot_rows):
    rows = events(1, 400, span=20_000)
    found = summed(sessions(frame(spark, rows), ["user"], "ts", GAP, measures(), hot_rows, panes_per_block))
    ordered = found.select("user", "session_start", "session_end", "n", "low", "high", "sum")
    assert sorted_rows(ordered) == walked(rows, GAP)


@pytest.mark.parametrize("hot_rows", [0, 10_000])
@pytest.mark.parametrize("panes_per_block", [1, 3])
def test_sessions_at_exact_gaps(spark, panes_per_block, hot_rows):
    steps = [0, 60, 120, 180.000001, 241, 301.000002, 361.000002, 900, 959.999999]
    rows = [(i, 1, at(s), 1.0) for i, s in enumerate(steps)]
    found = summed(sessions(frame(spark, rows), ["user"], "ts", GAP, measures(), hot_rows, panes_per_block))
    ordered = found.select("user", "session_start", "session_end", "n", "low", "high", "sum")
    assert sorted_rows(ordered) == walked(rows, GAP)


def test_sessions_match_spark(spark):
    df = frame(spark, events(2, 500, span=30_000))
    own = sessions(df, ["user"], "ts", GAP, [count("n")], hot_rows=0, panes_per_block=4)
    window = F.session_window("ts", "60 seconds").alias("w")
    theirs = df.groupBy("user", window).agg(F.count("*").alias("n"))
    assert sorted_rows(own) == sorted_rows(theirs.select("user", "w.start", "w.end", "n"))


@pytest.mark.parametrize("slide", [600, 300, 240, 60])
def test_sliding_matches_spark(spark, slide):
    df = frame(spark, events(3, 300))
    own = sliding(df, ["user"], "ts", timedelta(seconds=600), timedelta(seconds=slide), [count("n")])
    window = F.window("ts", "600 seconds", f"{slide} seconds").alias("w")
    theirs = df.groupBy("user", window).agg(F.count("*").alias("n"))
    assert sorted_rows(own) == sorted_rows(theirs.select("user", "w.start", "w.end", "n"))


def test_tumbling_before_1970(spark):
    rows = [(0, 1, at(-60 * 365 * 86400), 1.0), (1, 1, at(0), 2.0), (2, 1, None, 3.0)]
    found = tumbling(frame(spark, rows), ["user"], "ts", timedelta(days=1), [count("n")])
    assert all(r["window_start"] < r["window_end"] and r["n"] == 1 for r in found.collect())
    assert found.count() == 2


@pytest.mark.parametrize("hot_rows", [10**7, 0])
def test_sessions_stay_whole_when_no_measure_is_used(spark, hot_rows):
    df = frame(spark, events(4, 300))
    found = sessions(df, ["user"], "ts", timedelta(seconds=60), [count("n")], hot_rows)
    spans = found.select("user", "session_start", "session_end")
    whole = len({tuple(r)[:3] for r in found.collect()})
    assert spans.distinct().count() == whole == found.count() < 250
