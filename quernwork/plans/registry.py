"""All queries by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quernwork.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    """A query over the tables, and SQL that gives the same rows."""

    run: Callable[[Tables], DataFrame]
    sql: str


def registered() -> dict[str, Query]:
    from quernwork.plans import customers, events, orders, pricing, spans, streams, summaries

    modules = (pricing, orders, customers, events, streams, spans, summaries)
    return {name: query for module in modules for name, query in module.QUERIES.items()}
