"""Revenue from local suppliers, with suppliers broadcast and without."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quernwork.plans.pricing import QUERIES, revenue_from_local_suppliers
from quernwork.sources import Tables
from quernwork.sources.schemas import SCHEMAS
from tests.oracle import assert_same
from tests.test_plans import final_plan

KINDS = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "timestamp_ntz": pa.timestamp("us")}
NATIONS = [(n, f"N{n}") for n in range(4)] + [(None, "none"), (5, None)]
# Supplier 3 comes twice in one nation, 4 in two; 6 has no nation, one has no key.
SUPPLIERS = [(1, 1), (2, 2), (3, 3), (3, 3), (4, 0), (4, 1), (5, 5), (6, None), (None, 1)]
CUSTOMERS = [(c, c % 6) for c in range(12)] + [(7, 1), (20, None), (None, 1)]
ORDERS = [(o, o % 12) for o in range(60)] + [(10, 4), (11, 20), (None, 1), (70, None), (71, 99)]


def lines(odd=()):
    made = [(i % 65, i % 8, 100 + i + 0.25, (i % 10) / 100) for i in range(600)]
    made += [(None, 1, 5.0, 0.1), (1, None, 5.0, 0.1), (5, 5, None, 0.1), (1, 1, 7.0, None)]
    # All that is local in nation 0 comes from here.
    return [x for x in made if not (x[1] == 4 and (x[0] or 0) % 6 == 0)] + [(0, 4, None, 0.1), *odd]


def write(folder, tables):
    for name, (columns, rows) in tables.items():
        kinds = dict(c.split() for c in SCHEMAS[name].split(", "))
        given = dict(zip(columns, zip(*rows)))
        blank = [None] * len(rows)
        pq.write_table(
            pa.table({c: pa.array(given.get(c, blank), KINDS[k]) for c, k in kinds.items()}),
            f"{folder}/{name}.parquet",
        )
    return str(folder)


def made(folder, odd=()):
    return write(folder, {
        "nation": (["n_nationkey", "n_name"], NATIONS),
        "supplier": (["s_suppkey", "s_nationkey"], SUPPLIERS),
        "customer": (["c_custkey", "c_nationkey"], CUSTOMERS),
        "orders": (["o_orderkey", "o_custkey"], ORDERS),
        "lineitem": (["l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"], lines(odd)),
    })


@pytest.mark.parametrize("listed", [0, len(SUPPLIERS)])
def test_odd_rows_match_sql(spark, tmp_path, listed):
    folder = made(tmp_path)
    query = QUERIES["revenue_from_local_suppliers"]
    assert assert_same(revenue_from_local_suppliers(Tables(spark, folder), listed), folder, query.sql) == 5


@pytest.mark.parametrize("listed", [0, len(SUPPLIERS)])
@pytest.mark.parametrize("supplier", [2, 77])
def test_wrong_prices_are_an_error_whoever_supplies(spark, tmp_path, listed, supplier):
    tables = Tables(spark, made(tmp_path, [(1, supplier, 1.005, 0.1)]))
    with pytest.raises(Exception, match="more than two decimals"):
        revenue_from_local_suppliers(tables, listed).collect()


def test_lines_are_shuffled_once(spark):
    """By order; sums per supplier and nation, hardly fewer than lines, were shuffled as well."""
    plan = final_plan(revenue_from_local_suppliers(Tables(spark, "/root/testdata/sf0.01")))
    assert "hashpartitioning(l_suppkey" not in plan
