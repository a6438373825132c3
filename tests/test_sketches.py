"""Sketches as measures: near the exact result, however they are merged."""

import pytest
from pyspark.sql import functions as F

from quernwork.functions import (
    distinct_about,
    distinct_estimate,
    merges,
    partials,
    quantile_estimate,
    quantiles_about,
)
from quernwork.operators import grouping_totals, rollup_sets, sliding
from tests.fixtures import events, frame


def made(spark, rows=60_000):
    """A third of the rows in one group, many copies, some nulls."""
    return spark.range(rows).selectExpr(
        "IF(id % 3 = 0, 0, id % 7) AS g", "id % 5 AS h", "IF(id % 11 = 0, NULL, id % 9000) AS v", "pow(id % 977, 2) AS x"
    )


@pytest.mark.parametrize("parts", [1, 16])
def test_distinct_counts_through_a_rollup(spark, parts):
    df = made(spark).repartition(parts)
    dims = ["g", "h"]
    found = grouping_totals(df, dims, rollup_sets(dims), [distinct_about("n", "v")])
    got = {(r["level"], r["g"], r["h"]): r["n"] for r in found.withColumn("n", distinct_estimate("n")).collect()}
    rows = [r for r in df.select("g", "h", "v").collect()]
    for (level, g, h), about in got.items():
        exact = len({r["v"] for r in rows if (level == 3 or r["g"] == g) and (level > 0 or r["h"] == h)} - {None})
        assert abs(about - exact) <= max(1, 0.04 * exact)


def test_quantiles_through_merges(spark):
    df = made(spark)
    measure = quantiles_about("q", "x")
    merged = df.groupBy("g", "h").agg(*partials([measure])).groupBy("g").agg(*merges([measure]))
    values = {}
    for r in df.select("g", "x").collect():
        values.setdefault(r["g"], []).append(r["x"])
    for share in (0.0, 0.1, 0.5, 0.99, 1.0):
        for r in merged.select("g", quantile_estimate("q", share).alias("v")).collect():
            own = values[r["g"]]
            below, upto = sum(x < r["v"] for x in own) / len(own), sum(x <= r["v"] for x in own) / len(own)
            assert below - 0.02 <= share <= upto + 0.02


def test_sketches_in_sliding_windows(spark):
    from datetime import timedelta

    df = frame(spark, [r for r in events(9, 500) if r[2] is not None])
    windows = sliding(df, [], "ts", timedelta(minutes=10), timedelta(minutes=5), [distinct_about("n", "id")])
    for r in windows.withColumn("n", distinct_estimate("n")).collect():
        exact = df.where((F.col("ts") >= F.lit(r["window_start"])) & (F.col("ts") < F.lit(r["window_end"]))).count()
        assert abs(r["n"] - exact) <= max(1, 0.04 * exact)


def test_nothing_to_count(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (2, 5, 1.5)], "g int, v int, x double")
    measures = [distinct_about("n", "v"), quantiles_about("q", "x")]
    found = df.groupBy("g").agg(*partials(measures))
    rows = found.select("g", distinct_estimate("n").alias("n"), quantile_estimate("q", 0.5).alias("q")).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, None), (2, 1, 1.5)]
    assert df.where("g > 2").groupBy("g").agg(*partials(measures)).collect() == []


def test_partial_sketches_are_what_is_shuffled(spark):
    plan = made(spark).groupBy("g").agg(*partials([distinct_about("n", "v")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_hll_sketch_agg") > plan.index("Exchange")
