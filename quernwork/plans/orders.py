"""Orders with and without matching rows, ranked, and as sets of keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernwork import operators
from quernwork.operators import having, lacking, top_k
from quernwork.plans.registry import Query
from quernwork.sources import Tables

_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]


def orders_without_lines(tables: Tables) -> DataFrame:
    orders = tables.read("orders", *_ORDER_COLUMNS)
    return lacking(orders, tables.read("lineitem", "l_orderkey"), ("o_orderkey", "l_orderkey"), unique=True)


_ORDERS_WITHOUT_LINES_SQL = """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate
FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
"""


def orders_with_returns(tables: Tables) -> DataFrame:
    returned = tables.read("lineitem").where(F.col("l_returnflag") == "R")
    orders = tables.read("orders", *_ORDER_COLUMNS)
    return having(orders, returned, ("o_orderkey", "l_orderkey"), unique=True)


_ORDERS_WITH_RETURNS_SQL = """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate
FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
"""


def top_orders_per_customer(tables: Tables) -> DataFrame:
    orders = tables.read("orders", "o_custkey", "o_orderkey", "o_totalprice")
    return top_k(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


_TOP_ORDERS_PER_CUSTOMER_SQL = """
SELECT o_custkey, o_orderkey, o_totalprice,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER)
         AS rank
FROM orders
QUALIFY rank <= 3
"""


def top_orders_per_priority(tables: Tables) -> DataFrame:
    orders = tables.read("orders", "o_orderpriority", "o_orderkey", "o_totalprice", "o_orderdate")
    return top_k(orders, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


_TOP_ORDERS_PER_PRIORITY_SQL = """
SELECT o_orderpriority, o_orderkey, o_totalprice, o_orderdate,
       CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)
         AS INTEGER) AS rank
FROM orders
QUALIFY rank <= 10
"""


def _customers_of_orders(tables: Tables, status: str) -> DataFrame:
    orders = tables.read("orders").where(F.col("o_orderstatus") == status)
    return orders.select(F.col("o_custkey").alias("custkey"))


def _key_sets(name: str) -> Callable[[Tables], DataFrame]:
    """A set operation on customers with open orders and those with filled ones."""
    combine = getattr(operators, name)

    def run(tables: Tables) -> DataFrame:
        return combine(_customers_of_orders(tables, "O"), _customers_of_orders(tables, "F"))

    return run


def _key_sets_sql(operation: str) -> str:
    return f"""
SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'O'
{operation}
SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F'
"""


def customers_without_orders(tables: Tables) -> DataFrame:
    customers = tables.read("customer").select(F.col("c_custkey").alias("custkey"))
    ordering = tables.read("orders").select(F.col("o_custkey").alias("custkey"))
    return operators.except_distinct(customers, ordering)


_CUSTOMERS_WITHOUT_ORDERS_SQL = """
SELECT c_custkey AS custkey FROM customer
EXCEPT
SELECT o_custkey AS custkey FROM orders
"""

QUERIES = {
    "orders_without_lines": Query(orders_without_lines, _ORDERS_WITHOUT_LINES_SQL),
    "orders_with_returns": Query(orders_with_returns, _ORDERS_WITH_RETURNS_SQL),
    "top_orders_per_customer": Query(top_orders_per_customer, _TOP_ORDERS_PER_CUSTOMER_SQL),
    "top_orders_per_priority": Query(top_orders_per_priority, _TOP_ORDERS_PER_PRIORITY_SQL),
    "customers_without_orders": Query(customers_without_orders, _CUSTOMERS_WITHOUT_ORDERS_SQL),
    "keys_union_all": Query(_key_sets("union_all"), _key_sets_sql("UNION ALL")),
    "keys_union": Query(_key_sets("union_distinct"), _key_sets_sql("UNION")),
    "keys_intersect": Query(_key_sets("intersect_distinct"), _key_sets_sql("INTERSECT")),
    "keys_intersect_all": Query(_key_sets("intersect_all"), _key_sets_sql("INTERSECT ALL")),
    "keys_except": Query(_key_sets("except_distinct"), _key_sets_sql("EXCEPT")),
    "keys_except_all": Query(_key_sets("except_all"), _key_sets_sql("EXCEPT ALL")),
}
