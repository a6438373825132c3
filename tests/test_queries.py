"""Every registered query against its SQL, on the given tables."""

import pytest

import __spark_entry__ as contract
from quernwork.plans import registered
from tests.oracle import assert_same

SQL = contract.oracle_sql()


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name, scale):
    folder = f"/root/testdata/{scale}"
    assert_same(contract.queries()[name](spark, folder), folder, SQL[name])


def test_entry(spark):
    assert contract.entry(spark).count() == 5


def test_every_table_query_has_sql():
    assert registered().keys() <= SQL.keys() <= contract.queries().keys()
