"""SKU margins, stock runway, return spikes and best sellers from order lines.

Canonical lines: order_id, sku, line_date, units, line_revenue, line_cogs, returned.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginlake.functions.money import dec, money_sum, percent_or_null, ratio_or_null, zero_if_null
from marginlake.operators.detect import z_score


def sku_margins(
    lines: DataFrame, orders: DataFrame, *, by: Sequence[str] = ()
) -> DataFrame:
    """Lines, units, revenue, cost, refunds and margin per SKU.

    Order shipping is split over the lines by their share of the order's revenue
    (six decimals per line). The lines move once, to meet the order totals, and are
    then summed per SKU before moving again. Totals come from a map-side combined
    aggregate and a join, not from a window over the lines of an order: an oversized
    order is then a skewed join partition, which adaptive execution can split.
    """
    order = [*by, "order_id"]
    totals = (
        lines.groupBy(*order)
        .agg(money_sum("line_revenue").alias("order_revenue"))
        .join(orders.select(*order, "shipping_cost"), order)
    )
    # These widths leave the quotient 15 decimals, so rounding to six is exact.
    share = F.round(
        F.col("shipping_cost").cast("decimal(10,2)")
        * F.col("line_revenue").cast("decimal(14,2)")
        / F.nullif(F.col("order_revenue"), F.lit(0)).cast("decimal(14,2)"),
        6,
    )
    # Summed as whole millionths, like money as whole cents.
    millionths = F.sum((share * 1_000_000).cast("long")).cast("decimal(19,0)")
    back = F.col("returned")
    sums = (
        lines.join(totals, order, "left")
        .groupBy(*by, "sku")
        .agg(
            F.count(F.lit(1)).alias("order_lines"),
            F.sum("units").alias("units_sold"),
            F.sum(F.when(back, F.col("units")).otherwise(F.lit(0))).alias("units_returned"),
            money_sum("line_revenue").alias("gross_revenue"),
            zero_if_null(money_sum(F.when(back, F.col("line_revenue")))).alias("refunded_revenue"),
            money_sum("line_cogs").alias("total_cogs"),
            F.round(zero_if_null(millionths * dec("0.000001", 7, 6)), 2)
            .cast("decimal(20,2)")
            .alias("allocated_shipping"),
        )
    )
    profit = (
        F.col("gross_revenue")
        - F.col("refunded_revenue")
        - F.col("total_cogs")
        - F.col("allocated_shipping")
    )
    return sums.withColumn("net_profit", profit).withColumns(
        {
            "return_rate_pct": percent_or_null(F.col("units_returned"), F.col("units_sold")),
            "net_margin_pct": percent_or_null(F.col("net_profit"), F.col("gross_revenue")),
        }
    )


def _day(as_of: dt.date | dt.datetime | str) -> dt.date:
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    return as_of.date() if isinstance(as_of, dt.datetime) else as_of


def stock_runway(
    lines: DataFrame,
    stock: DataFrame,
    *,
    as_of: dt.date | dt.datetime | str,
    days: int = 30,
    by: Sequence[str] = (),
) -> DataFrame:
    """Days until each SKU sells out at its trailing daily velocity.

    The window is a literal range on the line date, so older files are skipped.
    A SKU that did not sell has no run-out date (NULL).
    """
    end = _day(as_of)
    start = end - dt.timedelta(days=days)
    sold = (
        lines.where((F.col("line_date") >= F.lit(start)) & (F.col("line_date") < F.lit(end)))
        .groupBy(*by, "sku")
        .agg(F.sum("units").alias("units"))
    )
    units = zero_if_null(F.col("units"))
    return stock.join(sold, [*by, "sku"], "left").select(
        *by,
        "sku",
        "on_hand",
        units.alias("units_sold"),
        ratio_or_null(units, F.lit(days)).alias("daily_velocity"),
        ratio_or_null(F.col("on_hand") * F.lit(days), units, scale=1).alias("days_left"),
    )


def sku_return_spikes(
    lines: DataFrame, *, by: Sequence[str] = (), grain: str = "month", history: int = 7
) -> DataFrame:
    """Return rate per SKU and period with its z-score against the SKU's own past.

    The window of one SKU holds one row per period it sold in.
    """
    period = F.trunc("line_date", grain) if grain != "day" else F.col("line_date")
    returned = F.sum(F.when(F.col("returned"), F.col("units")).otherwise(F.lit(0)))
    rates = (
        lines.groupBy(*by, "sku", period.alias("period"))
        .agg(F.sum("units").alias("units"), returned.alias("units_returned"))
        .withColumn(
            "return_rate_pct", percent_or_null(F.col("units_returned"), F.col("units"))
        )
    )
    return z_score(rates, "return_rate_pct", by=[*by, "sku"], order="period", days=history)


def best_sellers(lines: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """The SKU with the most units per day; ties go to the lower SKU."""
    units = lines.groupBy(*by, F.col("line_date").alias("date"), "sku").agg(
        F.sum("units").alias("units")
    )
    # min_by over (-units, sku): most units first, then the lower SKU.
    rank = F.struct((-F.col("units")).alias("u"), F.col("sku").alias("s"))
    return units.groupBy(*by, "date").agg(
        F.min_by(F.struct("sku", "units"), rank).alias("best")
    ).select(*by, "date", F.col("best.sku").alias("best_seller"), F.col("best.units").alias("best_seller_units"))
