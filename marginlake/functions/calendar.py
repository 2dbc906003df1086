"""Dates: months, windows, recency."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_MICROS = 86_400_000_000


def moment(value: dt.datetime | str) -> Column:
    """A timestamp literal in the session time zone."""
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast("timestamp")


def days_before(at: Column, days: int) -> Column:
    return at - F.expr(f"INTERVAL {int(days)} DAYS")


def month_of(c: Column) -> Column:
    """First day of the month as a date."""
    return F.trunc(c, "month")


def months_between(later: Column, earlier: Column) -> Column:
    """Whole calendar months from ``earlier`` to ``later``."""
    years = F.year(later) - F.year(earlier)
    return years * 12 + (F.month(later) - F.month(earlier))


def month_index(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c) - 1


def recency_days(as_of: Column, last: Column) -> Column:
    """Days since ``last``, rounded to the nearest whole day (halves go up)."""
    gap = F.unix_micros(as_of) - F.unix_micros(last.cast("timestamp"))
    return F.floor((gap + F.lit(_DAY_MICROS // 2)) / F.lit(float(_DAY_MICROS))).cast("int")


def in_window(t: Column, start: Column, end: Column) -> Column:
    """Half-open range test: ``start <= t < end``."""
    return (t >= start) & (t < end)
