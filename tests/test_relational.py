"""Joins, rankings, subtotals and sums against plain Spark and plain Python."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quernwork.functions import (
    amount,
    cents,
    count,
    highest,
    lowest,
    merges,
    partials,
    total,
)
from quernwork.functions.measures import total_units
from quernwork.operators import (
    cube_sets,
    grouping_totals,
    having,
    heavy_keys,
    lacking,
    part_heavy,
    roll_up,
    rollup_sets,
    top_k,
)
from tests.fixtures import events, frame, sorted_rows


def test_having_and_lacking_keep_copies_and_null_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "k int, s string")
    right = spark.createDataFrame([(1,), (1,), (None,)], "other int")
    assert sorted_rows(having(left, right, ("k", "other"))) == [(1, "a"), (1, "a")]
    assert sorted_rows(lacking(left, right, ("k", "other"))) == [(None, "c"), (2, "b")]


def test_roll_up_equals_join_then_group(spark):
    facts = frame(spark, events(1, 300, null_share=0))
    dim = spark.createDataFrame([(i, "even" if i % 2 == 0 else "odd") for i in range(6)], "k int, g string")
    measures = [count("n"), total("sum", cents("value")), lowest("low", "value"), highest("high", "value")]
    fine = facts.groupBy("user").agg(*partials(measures))
    own = roll_up(fine, dim, ("user", "k"), ["g"], measures)
    plain = facts.join(dim, F.col("user") == F.col("k")).groupBy("g").agg(*partials(measures))
    assert sorted_rows(own) == sorted_rows(plain.select(*own.columns))


@pytest.mark.parametrize("unique", [True, False])
@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_hot_and_null_keys_of_the_left_side(spark, unique, hot_rows):
    rows = [(0 if i < 60 else 1 if i < 90 else None if i < 150 else i, i) for i in range(300)]
    left = spark.createDataFrame(rows, "k int, i int")
    right = spark.createDataFrame([(k,) for k in [0, 0, None, 155, 299, 999]], "other int")
    found = {0, 155, 299}
    on = ("k", "other")
    assert sorted_rows(having(left, right, on, unique, hot_rows)) == sorted(r for r in rows if r[0] in found)
    rest = [r for r in rows if r[0] not in found]
    assert sorted_rows(lacking(left, right, on, unique, hot_rows)) == sorted(rest, key=lambda r: (r[0] is not None, r))


def test_rows_of_hot_left_keys_are_not_shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(90_000).selectExpr("IF(id % 3 = 0, 7, id) AS k", "id")
        found = having(left, spark.range(1000).toDF("other"), ("k", "other"), hot_rows=1000)
        assert found.count() == 30_000 + 666
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The hot rows come from their scan through joins with broadcast lists alone.
    hot = plan[plan.index("Union") :].split("SortMergeJoin")
    assert len(hot) == 2 and plan.count("BroadcastHashJoin") >= 3


@pytest.mark.parametrize("k", [1001, 5000])
def test_a_large_top_k_ranks_pieces_first(spark, k):
    df = spark.range(20_000).selectExpr("id % 2 AS g", "id AS v")
    found = top_k(df, ["g"], [F.desc("v")], k)
    rows = sorted_rows(found.select("g", "rank", "v"))
    assert rows == [(g, n + 1, 19_998 + g - 2 * n) for g in (0, 1) for n in range(k)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    first = plan.rindex("Window [row_number")
    assert "_piece" in plan[first : first + 300]


@pytest.mark.parametrize("k", [5, 101])
def test_top_k_leaves_columns_of_any_name_alone(spark, k):
    df = spark.range(9000).selectExpr("id % 2 AS g", "id AS _piece", "9000 - id AS `a.b`", "id AS __piece")
    found = top_k(df, ["g"], [F.asc("_piece")], k)
    assert found.columns == [*df.columns, "rank"]
    want = [(g, 2 * n + g, 9000 - 2 * n - g, 2 * n + g, n + 1) for g in (0, 1) for n in range(k)]
    assert sorted_rows(found) == want


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_top_k(spark, k):
    rows = [r for r in events(2, 300) if r[1] is not None]
    found = top_k(frame(spark, rows), ["user"], [F.desc("value"), F.asc("id")], k)
    expected = []
    for user in {r[1] for r in rows}:
        best = sorted((r for r in rows if r[1] == user), key=lambda r: (-r[3], r[0]))[:k]
        expected += [(*r, n) for n, r in enumerate(best, 1)]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == sorted(expected, key=lambda r: r[0])


def test_top_k_limits_groups_before_the_shuffle(spark):
    found = top_k(spark.range(100).withColumn("g", F.col("id") % 5), ["g"], [F.col("id")], 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


DIM_ROWS = [
    (a, b, c, (a or 5) * 7.0 + b)
    for a in (1, 2, None)
    for b in (1, 2)
    for c in (1, None)
    for _ in range(a or 3)
]


@pytest.mark.parametrize("kind", ["rollup", "cube"])
def test_subtotals_match_spark(spark, kind):
    df = spark.createDataFrame(DIM_ROWS, "a int, b int, c int, v double")
    dims = ["a", "b", "c"]
    sets = rollup_sets(dims) if kind == "rollup" else cube_sets(dims)
    measures = [count("n"), lowest("low", "v"), highest("high", "v")]
    own = grouping_totals(df, dims, sets, measures)
    theirs = getattr(df, kind)(*dims).agg(
        F.grouping_id().cast("int").alias("level"), *partials(measures)
    )
    assert sorted_rows(own) == sorted_rows(theirs.select(*own.columns))


def test_grouping_sets(spark):
    assert rollup_sets(["a", "b"]) == [["a", "b"], ["a"], []]
    assert cube_sets(["a", "b"]) == [["a", "b"], ["a"], ["b"], []]


def test_totals_are_exact_past_a_long(spark):
    """Units whose plain sum does not fit a long, of both signs and with nulls."""
    big = 2**40 - 1
    df = spark.range(1 << 18).selectExpr(
        f"case when id % 5 = 0 then null when id % 7 = 0 then -3 else {big} end as units"
    )
    n = range(1 << 18)
    expected = sum(-3 if i % 7 == 0 else big for i in n if i % 5)
    measure = [total("t", F.col("units"))]
    parts = df.groupBy((F.lit(1)).alias("g")).agg(*partials(measure))
    many = parts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(1000))))
    found = many.groupBy("g").agg(*merges(measure)).select(total_units("t")).first()[0]
    assert expected * 1000 > 2**63
    assert found == Decimal(expected * 1000)


def test_amounts_round_half_up(spark):
    df = spark.createDataFrame([(25,), (-25,), (149,), (151,)], "u bigint")
    measure = [total("t", F.col("u"))]
    found = df.groupBy("u").agg(*partials(measure)).select("u", amount("t", 3).alias("a"))
    assert {r["u"]: r["a"] for r in found.collect()} == {25: 0.03, -25: -0.03, 149: 0.15, 151: 0.15}


def test_cents(spark):
    values = [0.29, 1.15, -994.28, 104997.88, 0.0, None, 8.41]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(cents("v")).collect()] == [29, 115, -99428, 10499788, 0, None, 841]


@pytest.mark.parametrize("value", [1.005, 0.001, -2.345])
def test_cents_refuse_more_decimals(spark, value):
    df = spark.createDataFrame([(value,)], "v double")
    with pytest.raises(Exception, match="more than two decimals"):
        df.select(cents("v")).collect()


def test_heavy_keys(spark):
    df = frame(spark, [(i, 0 if i < 50 else i, None, 0.0) for i in range(100)])
    assert [tuple(r) for r in heavy_keys(df, ["user"], 10).collect()] == [(0, 50)]


def test_part_heavy_takes_null_as_a_key(spark):
    df = frame(spark, [(i, None if i < 50 else i, None, 0.0) for i in range(100)])
    rest, heavy = part_heavy(df, ["user"], 10)
    assert (rest.count(), heavy.count()) == (50, 50)
    assert heavy.where("user is not null").count() == 0
    assert part_heavy(df, ["user"], 50)[1] is None
