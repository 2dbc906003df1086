"""Decimal arithmetic: exact sums, two styles of safe division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
SMALL_MONEY = "decimal(10,2)"

# Operands are widened to this before dividing. Wider still, and Catalyst
# would cut the quotient to six decimals.
_OPERAND = "decimal(24,4)"

# Cost of goods assumed where a source reports none: 35 % of revenue.
DEFAULT_COGS_RATE = "0.35"


def dec(value: str, precision: int = 12, scale: int = 4) -> Column:
    """An exact decimal literal."""
    return F.lit(value).cast(f"decimal({precision},{scale})")


def _quotient(num: Column, den: Column) -> Column:
    den = den.cast(_OPERAND)
    return num.cast(_OPERAND) / F.nullif(den, F.lit(0).cast(_OPERAND))


def ratio_or_null(num: Column, den: Column, scale: int = 2) -> Column:
    """``num / den`` rounded half up; NULL where the denominator is zero."""
    return F.round(_quotient(num, den), scale)


def ratio_or_zero(num: Column, den: Column, scale: int = 2) -> Column:
    """``num / den`` rounded half up; zero unless the denominator is positive."""
    return F.coalesce(F.when(den > 0, ratio_or_null(num, den, scale)), F.lit(0))


def percent_or_null(num: Column, den: Column, scale: int = 2) -> Column:
    return ratio_or_null(num.cast(_OPERAND) * F.lit(100), den, scale)


def percent_or_zero(num: Column, den: Column, scale: int = 2) -> Column:
    return F.coalesce(F.when(den > 0, percent_or_null(num, den, scale)), F.lit(0))


def float_ratio_or_zero(num: Column, den: Column) -> Column:
    """Unrounded ``double`` quotient of two exact values; zero unless ``den`` > 0."""
    n, d = num.cast("double"), den.cast("double")
    return F.coalesce(F.when(d > 0, n / F.nullif(d, F.lit(0.0))), F.lit(0.0))


def percent_change(current: Column, previous: Column) -> Column:
    """Change in percent, unrounded; zero when there is no positive base."""
    cur, prev = current.cast("double"), previous.cast("double")
    return F.coalesce(
        F.when(prev > 0, (cur - prev) / F.nullif(prev, F.lit(0.0)) * 100.0), F.lit(0.0)
    )


def default_cogs(revenue: Column, type_: str = MONEY) -> Column:
    return F.round(revenue * dec(DEFAULT_COGS_RATE, 3, 2), 2).cast(type_)


def money_sum(amount: Column | str) -> Column:
    """Exact sum of amounts, as decimal(20,2).

    Every amount is rounded half up to two decimals first; doubles and finer
    decimals lose nothing but what lies below a cent. Adds whole cents as 64-bit integers: an aggregation buffer of one machine word
    where a decimal sum needs an arbitrary-precision object per added row. Sums
    beyond 90 quadrillion fail loudly instead of wrapping.
    """
    c = F.col(amount) if isinstance(amount, str) else amount
    cents = F.sum(F.round(c * 100, 0).cast("long"))
    return (cents.cast("decimal(19,0)") * dec("0.01", 3, 2)).cast("decimal(20,2)")


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))
