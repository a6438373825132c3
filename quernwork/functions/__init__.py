"""Column expressions and measures the operators share."""

from quernwork.functions.measures import (
    Measure,
    columns,
    count,
    distinct_about,
    distinct_estimate,
    highest,
    lowest,
    merges,
    partials,
    quantile_estimate,
    quantiles_about,
    total,
)
from quernwork.functions.money import amount, cents, discounted, taxed
from quernwork.functions.times import micros, ticks
from quernwork.functions.variants import field, kind, parsed

__all__ = [
    "Measure",
    "amount",
    "cents",
    "columns",
    "count",
    "discounted",
    "distinct_about",
    "distinct_estimate",
    "field",
    "highest",
    "kind",
    "lowest",
    "merges",
    "micros",
    "parsed",
    "partials",
    "quantile_estimate",
    "quantiles_about",
    "taxed",
    "total",
]
