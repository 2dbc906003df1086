"""Workspace KPIs: overview, deltas, trend, channels, spend mix, window profit.

Inputs are canonical orders and ad spend. ``as_of`` is always explicit. Sums are
exact decimals; ratios that the reports leave unrounded are doubles of those sums.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginlake.functions.calendar import days_before, in_window, moment, month_of
from marginlake.functions.money import float_ratio_or_zero, money_sum, percent_change, zero_if_null
from marginlake.functions.text import day_label

PAID = "paid"
# Reported channels, in report order.
CHANNELS = ("Meta", "Google", "TikTok")
# Operating expenses assumed by the second contribution margin.
OPEX_RATE = "0.1"


def _sum_if(condition: Column, value: Column) -> Column:
    return zero_if_null(money_sum(F.when(condition, value)))


def _pair(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Put two aggregates side by side: by key, or one global row next to another."""
    if by:
        return left.join(right, list(by), "full_outer")
    return left.crossJoin(F.broadcast(right))  # a global aggregate is exactly one row


def overview(
    orders: DataFrame,
    ads: DataFrame,
    *,
    as_of: dt.datetime | str,
    by: Sequence[str] = (),
    completed: str = PAID,
) -> DataFrame:
    """All-time unit metrics and 14-day deltas, from one pass over each table."""
    now = moment(as_of)
    windows = {
        "last": (days_before(now, 14), now),
        "prev": (days_before(now, 28), days_before(now, 14)),
    }
    paid = orders.where(F.col("status") == completed)
    placed, day = F.col("order_date"), F.col("date").cast("timestamp")
    sold = paid.groupBy(*by).agg(
        zero_if_null(money_sum("gross_revenue")).alias("revenue"),
        F.count(F.lit(1)).alias("orders"),
        zero_if_null(money_sum("cogs")).alias("cogs"),
        zero_if_null(money_sum("shipping_cost")).alias("shipping"),
        *[
            _sum_if(in_window(placed, *w), F.col("gross_revenue")).alias(f"{k}_revenue")
            for k, w in windows.items()
        ],
        *[F.count_if(in_window(placed, *w)).alias(f"{k}_orders") for k, w in windows.items()],
    )
    spent = ads.groupBy(*by).agg(
        zero_if_null(money_sum("spend")).alias("spend"),
        *[
            _sum_if(in_window(day, *w), F.col("spend")).alias(f"{k}_spend")
            for k, w in windows.items()
        ],
    )
    sums = _pair(sold, spent, by)
    sums = sums.select(
        *by, *[zero_if_null(F.col(c)).alias(c) for c in sums.columns if c not in by]
    )
    c = F.col
    gross = c("revenue") - c("cogs") - c("shipping")
    cm1 = gross - c("spend")
    cm2 = cm1 - c("revenue") * F.lit(OPEX_RATE).cast("decimal(2,1)")
    roas = {k: float_ratio_or_zero(c(f"{k}_revenue"), c(f"{k}_spend")) for k in windows}
    cac = {k: float_ratio_or_zero(c(f"{k}_spend"), c(f"{k}_orders")) for k in windows}
    return sums.select(
        *by,
        c("revenue"),
        c("orders"),
        c("spend").alias("ad_spend"),
        float_ratio_or_zero(c("revenue"), c("spend")).alias("roas"),
        float_ratio_or_zero(c("spend"), c("orders")).alias("cac"),
        gross.alias("gross_profit"),
        cm1.alias("cm1"),
        cm2.alias("cm2"),
        (float_ratio_or_zero(cm2, c("revenue")) * 100.0).alias("net_margin"),
        float_ratio_or_zero(c("revenue"), c("orders")).alias("aov"),
        c("cogs").alias("total_cogs"),
        c("shipping").alias("total_shipping"),
        percent_change(c("last_revenue"), c("prev_revenue")).alias("revenue_delta"),
        percent_change(c("last_orders"), c("prev_orders")).alias("orders_delta"),
        percent_change(c("last_spend"), c("prev_spend")).alias("spend_delta"),
        percent_change(roas["last"], roas["prev"]).alias("roas_delta"),
        percent_change(cac["last"], cac["prev"]).alias("cac_delta"),
    )


METRICS = (
    "revenue",
    "orders",
    "ad_spend",
    "roas",
    "cac",
    "gross_profit",
    "cm1",
    "cm2",
    "net_margin",
    "aov",
    "total_cogs",
    "total_shipping",
)
DELTAS = ("revenue_delta", "orders_delta", "spend_delta", "roas_delta", "cac_delta")


def overview_metrics(overview_row: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    return overview_row.select(*by, *METRICS)


def trailing_deltas(overview_row: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    return overview_row.select(*by, *DELTAS)


def _as_datetime(as_of: dt.datetime | str) -> dt.datetime:
    return as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(as_of)


def _day_list(first: dt.date, days: int) -> Column:
    last = first + dt.timedelta(days=days - 1)
    return F.explode(
        F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 DAY"))
    )


def daily_trend(
    orders: DataFrame,
    ads: DataFrame,
    *,
    as_of: dt.datetime | str,
    days: int = 60,
    by: Sequence[str] = (),
    tenants: DataFrame | None = None,
    completed: str = PAID,
) -> DataFrame:
    """Revenue, spend and orders for the ``days`` days before ``as_of``'s own day.

    Every day has a row, for each of ``tenants`` (rows of ``by``; without them, all
    that occur in either input, which reads both in full). The day bounds are literals on the raw time columns, so
    the scans skip everything outside the window.
    """
    spark = orders.sparkSession
    first = (_as_datetime(as_of) - dt.timedelta(days=days)).date()
    start, end = F.lit(first), F.lit(first + dt.timedelta(days=days))
    keys = [*by, "date"]

    sold = (
        orders.where(F.col("status") == completed)
        .where(in_window(F.col("order_date"), start.cast("timestamp"), end.cast("timestamp")))
        .groupBy(*by, F.to_date("order_date").alias("date"))
        .agg(money_sum("gross_revenue").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    )
    spent = (
        ads.where(in_window(F.col("date").cast("timestamp"), start.cast("timestamp"), end.cast("timestamp")))
        .groupBy(*by, F.to_date("date").alias("date"))
        .agg(money_sum("spend").alias("ad_spend"))
    )
    if by:
        owners = tenants if tenants is not None else orders.select(*by).union(ads.select(*by)).distinct()
    else:
        owners = spark.range(1).select()
    calendar = owners.select(*by, _day_list(first, days).alias("date"))
    return (
        calendar.join(sold, keys, "left")
        .join(spent, keys, "left")
        .select(
            *keys,
            day_label(F.col("date")).alias("label"),
            zero_if_null(F.col("revenue")).alias("revenue"),
            zero_if_null(F.col("ad_spend")).alias("ad_spend"),
            zero_if_null(F.col("orders")).alias("orders"),
        )
    )


def channel_breakdown(
    orders: DataFrame,
    ads: DataFrame,
    *,
    by: Sequence[str] = (),
    tenants: DataFrame | None = None,
    completed: str = PAID,
    channels: Sequence[str] = CHANNELS,
) -> DataFrame:
    """Spend, revenue, orders, traffic, ROAS, CAC and CPM for each reported channel.

    Reported channels always appear, for each of ``tenants`` (rows of ``by``; without
    them, all that occur in either input); others never do. The channel filter is pushed
    to both scans; what is joined afterwards has one row per channel.
    """
    spark = orders.sparkSession
    keys = [*by, "channel"]
    listed = list(channels)
    sold = (
        orders.where((F.col("status") == completed) & F.col("acquisition_channel").isin(listed))
        .groupBy(*by, F.col("acquisition_channel").alias("channel"))
        .agg(money_sum("gross_revenue").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    )
    spent = (
        ads.where(F.col("channel").isin(listed))
        .groupBy(*keys)
        .agg(
            money_sum("spend").alias("spend"),
            *[F.sum(c).alias(c) for c in ("impressions", "clicks", "conversions")],
        )
    )
    if by:
        owners = tenants if tenants is not None else orders.select(*by).union(ads.select(*by)).distinct()
    else:
        owners = spark.range(1).select()
    fixed = owners.select(
        *by, F.posexplode(F.array(*[F.lit(c) for c in listed])).alias("position", "channel")
    )
    joined = fixed.join(sold, keys, "left").join(spent, keys, "left")
    numbers = ("spend", "revenue", "orders", "conversions", "impressions", "clicks")
    filled = joined.select(
        *keys, "position", *[zero_if_null(F.col(c)).alias(c) for c in numbers]
    )
    return filled.select(
        *keys,
        "position",
        *numbers,
        float_ratio_or_zero(F.col("revenue"), F.col("spend")).alias("roas"),
        float_ratio_or_zero(F.col("spend"), F.col("orders")).alias("cac"),
        (float_ratio_or_zero(F.col("spend"), F.col("impressions")) * 1000.0).alias("cpm"),
    )


def spend_mix(breakdown: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Each reported channel's share of their spend, in percent."""
    total = F.sum("spend").over(Window.partitionBy(*by))
    return breakdown.select(
        *by,
        "channel",
        "spend",
        (float_ratio_or_zero(F.col("spend"), total) * 100.0).alias("share_pct"),
    )


def window_profit(
    orders: DataFrame,
    ads: DataFrame,
    *,
    as_of: dt.datetime | str,
    by: Sequence[str] = (),
    completed: str = PAID,
) -> DataFrame:
    """Profit after spend over the last 7 days and the month to date.

    Orders and spend become signed amounts in one stream, summed once; rows older
    than both windows are dropped at the scan.
    """
    now = moment(as_of)
    week = days_before(now, 7)
    month = month_of(now).cast("timestamp")
    gain = F.col("gross_revenue") - F.col("cogs") - F.col("shipping_cost")
    flows = (
        orders.where(F.col("status") == completed)
        .select(*by, F.col("order_date").cast("timestamp").alias("at"), gain.cast("decimal(14,2)").alias("amount"))
        .unionByName(
            ads.select(
                *by,
                F.col("date").cast("timestamp").alias("at"),
                (-F.col("spend")).cast("decimal(14,2)").alias("amount"),
            )
        )
        .where(in_window(F.col("at"), F.least(week, month), now))
    )
    return flows.groupBy(*by).agg(
        _sum_if(F.col("at") >= week, F.col("amount")).alias("week_profit"),
        _sum_if(F.col("at") >= month, F.col("amount")).alias("month_profit"),
    )


def insight_row(
    orders: DataFrame,
    ads: DataFrame,
    *,
    as_of: dt.datetime | str,
    profit_as_of: dt.datetime | str,
    completed: str = PAID,
    channels: Sequence[str] = CHANNELS,
) -> DataFrame:
    """One row with all sums that insights are made of, from one pass over each table.

    channels: an array of (roas, rank, channel) that orders as reports do, so that its greatest
    is the best; week_profit and month_profit; cac and cac_delta.
    """
    now, then = moment(as_of), moment(profit_as_of)
    last, prev = (days_before(now, 14), now), (days_before(now, 28), days_before(now, 14))
    profit = {"week": (days_before(then, 7), then), "month": (month_of(then).cast("timestamp"), then)}
    placed, day = F.col("order_date").cast("timestamp"), F.col("date").cast("timestamp")
    gain = (F.col("gross_revenue") - F.col("cogs") - F.col("shipping_cost")).cast("decimal(14,2)")
    revenue, spend = F.col("gross_revenue"), F.col("spend")
    sold = orders.where(F.col("status") == completed).agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(in_window(placed, *last)).alias("last_orders"),
        F.count_if(in_window(placed, *prev)).alias("prev_orders"),
        *[_sum_if(in_window(placed, *w), gain).alias(f"{k}_gain") for k, w in profit.items()],
        *[_sum_if(F.col("acquisition_channel") == c, revenue).alias(f"revenue_{k}") for k, c in enumerate(channels)],
    )
    spent = ads.agg(
        zero_if_null(money_sum("spend")).alias("spend"),
        _sum_if(in_window(day, *last), spend).alias("last_spend"),
        _sum_if(in_window(day, *prev), spend).alias("prev_spend"),
        *[_sum_if(in_window(day, *w), spend).alias(f"{k}_spend") for k, w in profit.items()],
        *[_sum_if(F.col("channel") == c, spend).alias(f"spend_{k}") for k, c in enumerate(channels)],
    )
    c = F.col
    cac = {k: float_ratio_or_zero(c(f"{k}_spend"), c(f"{k}_orders")) for k in ("last", "prev")}
    ranked = [
        F.struct(
            float_ratio_or_zero(c(f"revenue_{k}"), c(f"spend_{k}")).alias("roas"),
            F.lit(-k).alias("rank"),
            F.lit(name).alias("channel"),
        )
        for k, name in enumerate(channels)
    ]
    return _pair(sold, spent, ()).select(
        F.array(*ranked).alias("channels"),
        (c("week_gain") - c("week_spend")).alias("week_profit"),
        (c("month_gain") - c("month_spend")).alias("month_profit"),
        float_ratio_or_zero(c("spend"), c("orders")).alias("cac"),
        percent_change(cac["last"], cac["prev"]).alias("cac_delta"),
    )
