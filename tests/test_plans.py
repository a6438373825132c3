"""Physical plans of the registered queries: what they scan, shuffle and avoid."""

import re
from datetime import timedelta

import pytest

from quernwork.functions import count
from quernwork.operators import except_all, sessions
from quernwork.plans import registered
from quernwork.plans.events import event_before_purchase
from quernwork.sources import Tables
from tests.fixtures import events, frame

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plans(spark):
    """Plans made as for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    tables = Tables(spark, FOLDER)
    made = {
        name: query.run(tables)._jdf.queryExecution().executedPlan().toString()
        for name, query in registered().items()
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return made


@pytest.mark.parametrize("name", sorted(registered()))
def test_no_pairs_no_python_no_single_task(plans, name):
    plan = plans[name]
    for word in ("Cartesian", "NestedLoop", "Python", "Pandas", "SinglePartition", "BroadcastExchange"):
        assert word not in plan, word


READ = {
    "pricing_summary": ["l_discount", "l_extendedprice", "l_linestatus", "l_quantity", "l_returnflag",
                        "l_shipdate", "l_tax"],
    "top_orders_per_customer": ["o_custkey", "o_orderkey", "o_totalprice"],
    "props_by_type": ["event_type", "props"],
    "events_per_day": ["event_type", "ts", "value"],
    "keys_except": ["o_custkey", "o_orderstatus"],
}


@pytest.mark.parametrize("name", READ)
def test_scans_read_only_the_columns_in_use(plans, name):
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plans[name]):
        assert sorted(c.split(":")[0] for c in schema.split(",")) == READ[name]


FILTERS = {
    "pricing_summary": "LessThanOrEqual(l_shipdate",
    "orders_with_returns": "EqualTo(l_returnflag,R)",
    "keys_intersect": "EqualTo(o_orderstatus,O)",
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_reach_the_scan(plans, name):
    assert FILTERS[name] in plans[name]


EXCHANGES = {
    "pricing_summary": 2,  # groups, order of the result
    "orders_without_lines": 2,  # orders, distinct keys of lines
    "keys_union": 1,
    "keys_intersect": 1,
    "customers_without_orders": 1,
    "top_orders_per_customer": 1,
    "top_orders_per_priority": 1,
    "events_per_day": 1,
    "events_sliding": 2,  # panes, windows
    "user_sessions": 1,
    "event_before_purchase": 1,
    "overlapping_orders": 3,  # either side by bin, customers
    "props_by_kind": 1,
    "revenue_by_priority": 1,  # priorities; the tables lie in buckets
}


@pytest.mark.parametrize("name", EXCHANGES)
def test_number_of_shuffles(plans, name):
    assert len(re.findall(r"\bExchange ", plans[name])) == EXCHANGES[name]


def test_fact_rows_are_combined_before_their_shuffle(plans):
    """Reading down from each exchange, what comes next is a partial aggregate."""
    for name in ("pricing_summary", "revenue_by_brand_and_year", "events_per_day", "props_by_type"):
        lines = plans[name].splitlines()
        scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
        last = max(i for i, line in enumerate(lines[:scan]) if re.search(r"\bExchange hash", line))
        assert "partial_" in lines[last + 1], name


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_both_ways_of_a_result_read_one_shuffle(spark):
    """Short and long runs of copies, settled and open sessions: each pair shares its input."""
    left, right = (spark.range(n).selectExpr("id % 7 as k") for n in (700, 70))
    few_and_many = except_all(left.unionAll(spark.range(3)), right, chunk=50)
    assert "ReusedExchange" in final_plan(few_and_many)

    df = frame(spark, events(1, 400, span=20_000))
    gap = timedelta(seconds=60)
    found = sessions(df, ["user"], "ts", gap, [count("n")], hot_rows=0, panes_per_block=3)
    assert "ReusedExchange" in final_plan(found)


@pytest.mark.parametrize("hot_rows, scans", [(10_000_000, 1), (60, 2)])
def test_events_are_read_once_or_twice_in_the_as_of_join(spark, hot_rows, scans):
    """Twice where a key is hot: what stands before each piece is fetched by a join."""
    joined = event_before_purchase(Tables(spark, "/root/testdata/sf0.01"), hot_rows)
    plan = final_plan(joined)
    assert plan.count("FileScan parquet") == scans
    assert "SortMergeJoin" not in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_no_taken_column_is_broadcast(spark):
    joined = event_before_purchase(Tables(spark, "/root/testdata/sf0.01"), 60)
    plan = final_plan(joined).splitlines()
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            for below in plan[i + 1 :]:
                if len(below) - len(below.lstrip(" :+-")) <= depth:
                    break
                assert "_right" not in below and "before_" not in below
