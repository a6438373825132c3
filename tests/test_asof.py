"""As-of join against a search through all rows."""

import pytest
from pyspark.sql import functions as F

from quernwork.functions import ticks
from quernwork.operators import asof_join, asof_within, cut_hot_keys
from quernwork.plans import registered
from quernwork.plans.events import event_before_purchase, user_sessions
from quernwork.sources import Tables
from tests.fixtures import at, events, frame, sorted_rows
from tests.oracle import assert_same


def searched(left, right, allow_equal):
    found = []
    for i, user, ts, value in left:
        best = None
        for j, other, then, _ in right:
            if user is None or ts is None or other != user or then is None:
                continue
            if then < ts or (allow_equal and then == ts):
                best = max(best, (then, j)) if best else (then, j)
        found.append((i, user, ts, value, *(best or (None, None))))
    return sorted(found, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("allow_equal", [True, False])
@pytest.mark.parametrize("hot_rows", [10_000_000, 40, 7])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_search(spark, seed, hot_rows, allow_equal):
    left, right = events(seed, 300), events(seed + 100, 200)
    joined = asof_join(
        frame(spark, left),
        frame(spark, right),
        by=["user"],
        left_time="ts",
        right_time="ts",
        take={"then": "ts", "other_id": "id"},
        spread=["id"],
        allow_equal=allow_equal,
        hot_rows=hot_rows,
    )
    assert sorted_rows(joined) == searched(left, right, allow_equal)


def test_no_right_rows(spark):
    left = frame(spark, events(3, 50))
    nothing = frame(spark, []).where("false")
    for hot_rows in (5, 1000):
        joined = asof_join(
            left, nothing, ["user"], "ts", "ts", {"then": "ts"}, ["id"], hot_rows=hot_rows
        )
        assert joined.count() == 50
        assert joined.where("then is not null").count() == 0


def test_two_keys(spark):
    rows = [(i, i % 2, at(i), float(i % 3)) for i in range(200)]
    df = frame(spark, rows)
    joined = asof_join(
        df, df, ["user", "value"], "ts", "ts", {"before": "id"}, ["id"], False, hot_rows=10
    )
    expected = {i: (i - 6 if i >= 6 else None) for i in range(200)}
    assert {r["id"]: r["before"] for r in joined.collect()} == expected


def cut(spark, rows, size):
    df = frame(spark, rows)
    slim = df.select("user", ticks(df, "ts").alias("tick"), ticks(df, "ts").alias("mark"))
    return cut_hot_keys(slim.where("tick IS NOT NULL"), ["user"], "tick", "mark", size)


def test_large_keys_are_cut_into_small_pieces(spark):
    # Half of the rows lie in a thousandth of the time.
    rows = [(i, 0 if i % 3 else 1 + i % 50, at(i if i % 2 else 5_000_000 + i), 0.0) for i in range(6000)]
    pieces = cut(spark, rows, 500)
    found = pieces.counts.collect()
    assert {r["user"] for r in found} == {0}
    assert sum(r["n_rows"] for r in found) == 4000 and max(r["n_rows"] for r in found) <= 500
    assert len(pieces.levels) > 1
    ordered = sorted(found, key=lambda r: r["_piece"])
    assert all(a["_high"] < b["_piece"] <= b["_low"] for a, b in zip(ordered, ordered[1:]))


def test_there_is_no_limit_on_pieces(spark):
    rows = [(i, 0, at(i), 0.0) for i in range(12_000)]
    assert cut(spark, rows, 2).n_counts > 4096


def test_no_large_keys_no_pieces(spark):
    assert cut(spark, events(5, 100), 1000) is None


@pytest.mark.parametrize("allow_equal", [True, False])
def test_one_crowded_time_is_spread(spark, allow_equal):
    """Left rows of one key and time go to several parts, and each finds its match."""
    left = [(i, 0, at(5), 0.0) for i in range(1000)] + [(2000, 0, at(3), 0.0), (2001, 0, at(9), 0.0)]
    right = [(i, 0, at(5), 0.0) for i in range(700)] + [(5000, 0, at(1), 0.0)]
    joined = asof_join(
        frame(spark, left), frame(spark, right), ["user"], "ts", "ts", {"then": "ts", "other": "id"}, ["id"],
        allow_equal, hot_rows=100,
    )
    assert sorted_rows(joined) == searched(left, right, allow_equal)


@pytest.mark.parametrize("hot_rows", [10_000_000, 30])
def test_two_parts_of_one_table(spark, hot_rows):
    rows = events(7, 400)
    df = frame(spark, rows)
    even, third = F.col("id") % 2 == 0, F.col("id") % 3 == 0
    joined = asof_within(
        df, even, third, df.columns, ["user"], "ts", {"then": "ts", "other": "id"}, ["id"], True, hot_rows
    )
    left, right = [r for r in rows if r[0] % 2 == 0], [r for r in rows if r[0] % 3 == 0]
    assert sorted_rows(joined) == searched(left, right, True)


@pytest.mark.parametrize("hot_rows", [10_000_000, 60, 20])
def test_registered_query_on_both_ways(spark, hot_rows):
    folder = "/root/testdata/sf0.01"
    found = event_before_purchase(Tables(spark, folder), hot_rows)
    assert_same(found, folder, registered()["event_before_purchase"].sql)
    sessions = user_sessions(Tables(spark, folder), hot_rows)
    assert_same(sessions, folder, registered()["user_sessions"].sql)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "int", "bigint"])
def test_ticks_keep_the_order_of_times(spark, kind):
    value = "id" if "int" in kind else "DATE(FROM_UNIXTIME(id * 100000))"
    df = spark.range(1, 5).selectExpr("id AS n", f"CAST({value} AS {kind}) AS t")
    found = df.orderBy("n").select(ticks(df, "t")).collect()
    assert [r[0] for r in found] == sorted({r[0] for r in found})
