"""Currency normalisation to one base currency."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlake.functions.money import dec

# US dollars per unit.
FX_RATES = {
    "USD": "1.0",
    "EUR": "1.08",
    "GBP": "1.28",
    "CAD": "0.74",
    "AUD": "0.65",
    "INR": "0.0119",
}


def currency_code(c: Column) -> Column:
    return F.upper(F.trim(c))


def _converted(amount: Column, code: Column, rate: Column, base: str, base_rate: Column | None) -> Column:
    """Known codes go by their rate over the base's; unknown ones and the base itself pass at 1.0."""
    known = amount * rate
    if base_rate is not None:
        known = known / base_rate
    return F.round(F.when(rate.isNull() | (code == F.lit(base)), amount).otherwise(known), 2)


def to_base(
    amount: Column, currency: Column, *, base: str = "USD", rates: Mapping[str, str] = FX_RATES
) -> Column:
    """Amount in ``base``, two decimals. Unknown codes pass through at 1.0."""
    table = F.create_map(*chain.from_iterable((F.lit(k), dec(v, 10, 6)) for k, v in rates.items()))
    code, base = currency_code(currency), base.strip().upper()
    base_rate = None if base == "USD" else dec(rates[base], 10, 6)
    return _converted(amount, code, F.try_element_at(table, code), base, base_rate)


def convert_with_table(
    df: DataFrame, rates: DataFrame, *, amount: str, currency: str, out: str, base: str = "USD"
) -> DataFrame:
    """Same rule with a rate table (code, rate); Catalyst picks the join by its size.

    A code that is listed more than once, in whatever case, has its largest
    rate. A base that is not listed counts as USD.
    """
    lookup = (
        rates.groupBy(currency_code(F.col("code")).alias("_code"))
        .agg(F.max(F.col("rate").cast("decimal(10,6)")).alias("_rate"))
        .where(F.col("_code").isNotNull())
    )
    base = base.strip().upper()
    joined = df.withColumn("_code", currency_code(F.col(currency))).join(lookup, "_code", "left")
    base_rate = None
    if base != "USD":
        joined = joined.crossJoin(  # one row
            lookup.where(F.col("_code") == base).agg(F.coalesce(F.max("_rate"), dec("1", 10, 6)).alias("_base_rate"))
        )
        base_rate = F.col("_base_rate")
    value = _converted(F.col(amount), F.col("_code"), F.col("_rate"), base, base_rate)
    return joined.withColumn(out, value).drop("_code", "_rate", "_base_rate")
