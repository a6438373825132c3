"""Money held as doubles of two decimals, made exact.

Sums of doubles depend on the order of their rows. Amounts are turned into whole
units first: cents, or fractions of a cent where a rate of two decimals is
multiplied in.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernwork.functions.measures import total_units


def cents(amount: str) -> Column:
    """Hundredths of an amount of two decimals; an amount of more is an error."""
    value, units = F.col(amount), F.rint(F.col(amount) * 100)
    # The double nearest to the hundredths is the amount itself, if it has no more. What
    # the error says is the same for all rows, which keeps the generated code short.
    wrong = F.raise_error(F.lit(f"{amount} has more than two decimals")).cast("bigint")
    return F.when(units / 100 == value, units.cast("bigint")).when(value.isNotNull(), wrong)


def discounted(price: str, discount: str) -> Column:
    """The price less its discount, in units of four decimals."""
    return cents(price) * (100 - cents(discount))


def taxed(price: str, discount: str, tax: str) -> Column:
    """The discounted price plus tax, in units of six decimals."""
    return discounted(price, discount) * (100 + cents(tax))


def amount(name: str, decimals: int = 2) -> Column:
    """A ``total`` of units of so many decimals, rounded to cents, as a double."""
    exact = total_units(name) * F.lit(Decimal(1).scaleb(-decimals))
    return exact.cast("decimal(38,2)").cast("double")
