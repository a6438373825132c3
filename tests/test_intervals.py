"""Overlaps against plain loops over all pairs."""

import random
from datetime import date, timedelta

import pytest

from quernwork.operators import overlap_join
from tests.fixtures import START, sorted_rows


def spans(seed, rows, name):
    """Rows of (key, from, to, id): a third of one key, spans of all lengths, odd ones too."""
    rnd, out = random.Random(seed), []
    for i in range(rows):
        key = 0 if rnd.random() < 1 / 3 else rnd.choice([1, 2, 3, None])
        start = rnd.choice([rnd.randrange(-500, 500), 7])
        length = rnd.choice([0, 1, 1, 5, 40, 700, -3])
        out.append((key, None if rnd.random() < 0.05 else start, start + length, i))
    return out


def brute(one, other):
    return sorted(
        (k, a, b, i, c, d, j)
        for k, a, b, i in one
        for m, c, d, j in other
        if k is not None and k == m and a is not None and c is not None and a < b and c < d and a < d and c < b
    )


@pytest.mark.parametrize("width, hot_rows", [(1, 10**7), (8, 10**7), (1000, 10**7), (8, 20), (1000, 7)])
def test_all_pairs_once(spark, width, hot_rows):
    one, other = spans(1, 150, "l"), spans(2, 120, "r")
    one += one[:5]
    left = spark.createDataFrame(one, "k int, a bigint, b bigint, i int")
    right = spark.createDataFrame(other, "k int, c bigint, d bigint, j int")
    found = overlap_join(left, right, ["k"], ("a", "b"), ("c", "d"), width, hot_rows)
    assert found.columns == ["k", "a", "b", "i", "c", "d", "j"]
    assert sorted_rows(found) == brute(one, other)


def test_points_and_several_keys(spark):
    left = spark.createDataFrame([(1, 2, 0, 10), (1, 3, 0, 10), (None, 2, 0, 10)], "g int, h int, a int, b int")
    right = spark.createDataFrame([(1, 2, t) for t in (-1, 0, 9, 10)], "g int, h int, t int")
    found = overlap_join(left, right, ["g", "h"], ("a", "b"), ("t", None), 4)
    assert sorted_rows(found) == [(1, 2, 0, 10, 0), (1, 2, 0, 10, 9)]


def test_times_dates_and_helper_names(spark):
    rows = [(1, START, START + timedelta(hours=1))]
    left = spark.createDataFrame(rows, "_k0 int, _bin timestamp_ntz, _level timestamp_ntz")
    right = spark.createDataFrame([(1, START + timedelta(minutes=59), 5)], "_k0 int, t timestamp_ntz, l_from int")
    found = overlap_join(left, right, ["_k0"], ("_bin", "_level"), ("t", None), 60_000_000)
    assert sorted_rows(found) == [(*rows[0], START + timedelta(minutes=59), 5)]
    days = spark.createDataFrame([(1, date(1969, 12, 1), date(1970, 2, 1))], "k int, a date, b date")
    one = spark.createDataFrame([(1, date(1970, 1, 31)), (1, date(1970, 2, 1))], "k int, t date")
    assert overlap_join(days, one, ["k"], ("a", "b"), ("t", None), 7).count() == 1


def test_empty_sides_and_names_of_both(spark):
    left = spark.createDataFrame([(1, 0, 10)], "k int, a int, b int")
    none = left.toDF("k", "c", "d").where("k > 5")
    assert overlap_join(left, none, ["k"], ("a", "b"), ("c", "d"), 4).collect() == []
    assert overlap_join(none, left, ["k"], ("c", "d"), ("a", "b"), 4).collect() == []
    with pytest.raises(ValueError, match="one name"):
        overlap_join(left, left, ["k"], ("a", "b"), ("a", "b"), 4)


def test_a_hot_bin_is_dealt_to_many_tasks(spark):
    """A third of the rows in one bin: the join's tasks see a part of them each."""
    left = spark.range(9000).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id AS a", "id + 1000000 AS b")
    right = spark.range(60).selectExpr("id % 2 AS k", "id AS c")
    found = overlap_join(left, right, ["k"], ("a", "b"), ("c", None), 1 << 21, hot_rows=300)
    want = sum(1 for i in range(0, 9000, 3) for c in range(0, 60, 2) if i <= c)
    want += sum(1 for i in (1,) for c in range(1, 60, 2) if i <= c)
    assert found.count() == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "_pl" in plan


def test_a_long_span_goes_to_few_bins(spark):
    from quernwork.operators.intervals import _Side

    df = spark.createDataFrame([(1, 0, 2**40), (1, 3, 2**40 + 5), (1, 5, 6)], "k int, a bigint, b bigint")
    side = _Side("l", df, ["k"], ("a", "b"))
    assert side.offered(1, side.levels(1)).count() <= 3 * 2 + 3
