"""Tables written by key: what later plans leave out."""

import pytest
from pyspark.sql import functions as F

from quernwork.sources import bucketed, dropped, partitioned
from tests.fixtures import sorted_rows


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_bucketed_tables_join_and_group_without_a_shuffle(spark, no_broadcast):
    left = spark.range(1000).selectExpr("IF(id % 3 = 0, NULL, id % 50) AS k", "id AS v")
    right = spark.range(60).selectExpr("id AS other", "id * 2 AS w")
    a, b = bucketed(left, ["k"], 4, "left_by_k"), bucketed(right, ["other"], 4)
    joined = a.join(b, a["k"] == b["other"]).groupBy("k").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    assert "Exchange" not in plan(joined)
    want = left.join(right, left["k"] == right["other"]).groupBy("k").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    assert sorted_rows(joined) == sorted_rows(want)
    assert sorted_rows(a) == sorted_rows(left) and a.columns == ["k", "v"]
    dropped(spark, "left_by_k")
    assert not spark.catalog.tableExists("left_by_k")


def test_partitions_are_pruned_while_a_join_runs(spark):
    rows = spark.range(4000).selectExpr("id % 20 AS day", "id AS v")
    path = partitioned(rows, ["day"])
    table = spark.read.parquet(path)
    days = spark.range(20).selectExpr("id AS d", "id % 10 AS kind")
    stored = spark.read.parquet(partitioned(days, ["kind"]))
    found = table.join(stored.where("kind = 3"), table["day"] == stored["d"])
    assert found.count() == 400
    assert "dynamicpruning" in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_large_value_is_written_by_many_tasks(spark):
    rows = spark.range(9000).selectExpr("IF(id % 3 = 0, NULL, 1) AS day", "id AS v")
    path = partitioned(rows, ["day"], files=6)
    read = spark.read.parquet(path)
    assert read.count() == 9000 and read.where("day IS NULL").count() == 3000
    assert len({r[0] for r in read.where("day = 1").select(F.input_file_name()).distinct().collect()}) > 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, v string")
    assert bucketed(none, ["k"], 2).collect() == []
