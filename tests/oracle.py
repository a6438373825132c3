"""Running the SQL of a query in DuckDB and comparing rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

# DuckDB type -> Spark type that holds the same values.
TYPES = {
    "VARCHAR": "string",
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "TIMESTAMP": "timestamp_ntz",
}


def run_sql(sf_dir: str, sql: str) -> tuple[dict[str, str], list[tuple]]:
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    relation = connection.sql(sql)
    types = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    return types, relation.fetchall()


def by_name(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with their columns in name order, sorted, nulls first."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is not None, v) for v in row))


def assert_same(df: DataFrame, sf_dir: str, sql: str) -> int:
    types, expected = run_sql(sf_dir, sql)
    assert dict(df.dtypes) == {c: TYPES[t] for c, t in types.items()}
    found = by_name(df.columns, [tuple(r) for r in df.collect()])
    wanted = by_name(list(types), expected)
    assert len(found) == len(wanted)
    for row, other in zip(found, wanted):
        assert row == other, (row, other)
    assert not any(isinstance(v, float) and math.isnan(v) for r in found for v in r)
    return len(found)
