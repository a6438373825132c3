"""Set operations against Spark's own, with nulls and many copies."""

import random

import pytest
from pyspark.sql import functions as F

from quernwork.operators import (
    except_all,
    except_distinct,
    intersect_all,
    intersect_distinct,
    union_all,
    union_distinct,
)
from tests.fixtures import sorted_rows

OPERATIONS = {
    "union_all": (union_all, lambda a, b: a.unionAll(b)),
    "union_distinct": (union_distinct, lambda a, b: a.unionAll(b).distinct()),
    "intersect_distinct": (intersect_distinct, lambda a, b: a.intersect(b)),
    "intersect_all": (intersect_all, lambda a, b: a.intersectAll(b)),
    "except_distinct": (except_distinct, lambda a, b: a.subtract(b)),
    "except_all": (except_all, lambda a, b: a.exceptAll(b)),
}


def pairs(seed):
    rng = random.Random(seed)
    return [
        (None if rng.random() < 0.1 else 0 if rng.random() < 0.4 else rng.randrange(12),
         None if rng.random() < 0.1 else rng.choice("ab"))
        for _ in range(200)
    ]


@pytest.mark.parametrize("name", OPERATIONS)
def test_matches_spark(spark, name):
    own, theirs = OPERATIONS[name]
    left = spark.createDataFrame(pairs(1), "k int, s string")
    right = spark.createDataFrame(pairs(2), "other int, name string")
    found = own(left, right)
    assert found.columns == ["k", "s"]
    assert sorted_rows(found) == sorted_rows(theirs(left, right))


@pytest.mark.parametrize("chunk", [1, 3, 7])
@pytest.mark.parametrize("name", ["intersect_all", "except_all"])
def test_long_runs_are_cut(spark, name, chunk):
    own, theirs = OPERATIONS[name]
    left = spark.createDataFrame(pairs(3), "k int, s string")
    right = spark.createDataFrame(pairs(4)[:120], "k int, s string")
    assert sorted_rows(own(left, right, chunk)) == sorted_rows(theirs(left, right))


def test_copies_of_one_row_spread_over_tasks(spark):
    left = spark.range(10_000).selectExpr("0 as k")
    right = spark.range(10).selectExpr("0 as k")
    found = except_all(left, right, chunk=100)
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 9_990
    assert len(sizes) > 1
