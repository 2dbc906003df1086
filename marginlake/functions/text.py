"""Report text: money, numbers, percentages and month labels as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Plain fixed-point text, half up, no thousands separators."""
    return F.round(value.cast("decimal(28,8)"), digits).cast(f"decimal(28,{digits})").cast("string")


def grouped(value: Column, digits: int = 0) -> Column:
    """Fixed-point text with thousands separators, half up."""
    return F.format_number(F.round(value.cast("decimal(28,8)"), digits), digits)


def currency_text(value: Column, compact: bool = False) -> Column:
    """``$`` text: cents below 100, whole dollars above, optionally 1.2k / 1.23M."""
    exact = value.cast("decimal(28,8)")
    size = F.abs(exact)
    body = F.when(size < 100, grouped(size, 2)).otherwise(grouped(size, 0))
    if compact:
        millions = size * F.lit("0.000001").cast("decimal(7,6)")
        thousands = size * F.lit("0.001").cast("decimal(4,3)")
        body = (
            F.when(size >= 1_000_000, F.concat(fixed(millions, 2), F.lit("M")))
            .when(size >= 1_000, F.concat(fixed(thousands, 1), F.lit("k")))
            .otherwise(body)
        )
    sign = F.when(exact < 0, "-").otherwise("")
    return F.concat(sign, F.lit("$"), body)


def number_text(value: Column) -> Column:
    """Thousands separators and up to three decimals, half up; no trailing zeros."""
    return F.regexp_replace(grouped(value, 3), r"\.?0+$", "")


def percent_text(value: Column, digits: int = 1) -> Column:
    return F.concat(fixed(value, digits), F.lit("%"))


def multiplier_text(value: Column, digits: int = 2) -> Column:
    return F.concat(fixed(value, digits), F.lit("x"))


def month_label(month: Column) -> Column:
    """``Jan 25``."""
    return F.date_format(month, "MMM yy")


def day_label(day: Column) -> Column:
    """``Jan 5``."""
    return F.date_format(day, "MMM d")
