"""Daily and per-channel profit marts.

All functions take staged frames (see ``staging``), return unsorted lazy frames,
and accept ``by``: extra leading group keys, so that one job serves all tenants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginlake.functions.money import (
    money_sum,
    percent_or_null,
    percent_or_zero,
    ratio_or_null,
    ratio_or_zero,
    zero_if_null,
)
from marginlake.functions.segments import velocity_label
from marginlake.operators.staging import (
    COMPLETED,
    REFUNDED,
    UNATTRIBUTED,
    completed_only,
    orders_counted,
)


def daily_unit_economics(
    orders: DataFrame,
    ads: DataFrame,
    *,
    by: Sequence[str] = (),
    completed: str = COMPLETED,
    unique_ids: bool = False,
    extended: bool = False,
) -> DataFrame:
    """Orders, revenue, spend, net profit, blended CAC and ROAS per day.

    Both sides are reduced to day grain before they meet, so the full outer join
    moves days, never orders. ``extended`` adds customer, cost and traffic totals.
    """
    keys = [*by, "date"]
    order_extras, ad_extras = {}, {}
    if extended:
        order_extras = {
            "total_customers": F.count_distinct("customer_id"),
            "total_cogs": money_sum("cogs"),
            "total_shipping": money_sum("shipping_cost"),
        }
        ad_extras = {"total_clicks": F.sum("clicks"), "total_impressions": F.sum("impressions")}

    sold = (
        completed_only(orders, completed)
        .withColumnRenamed("order_date", "date")
        .groupBy(*keys)
        .agg(
            orders_counted(unique_ids).alias("n"),
            money_sum("gross_revenue").alias("revenue"),
            money_sum("net_margin").alias("margin"),
            *[c.alias(name) for name, c in order_extras.items()],
        )
    )
    spent = (
        ads.withColumnRenamed("ad_date", "date")
        .groupBy(*keys)
        .agg(money_sum("ad_spend").alias("spend"), *[c.alias(name) for name, c in ad_extras.items()])
    )
    n, revenue, spend = (zero_if_null(F.col(c)) for c in ("n", "revenue", "spend"))
    return sold.join(spent, keys, "full_outer").select(
        *keys,
        n.alias("total_orders"),
        revenue.alias("total_revenue"),
        spend.alias("total_ad_spend"),
        (zero_if_null(F.col("margin")) - spend).alias("net_profit"),
        ratio_or_zero(spend, n).alias("blended_cac"),
        ratio_or_zero(revenue, spend).alias("blended_roas"),
        *[zero_if_null(F.col(name)).alias(name) for name in [*order_extras, *ad_extras]],
    )


def channel_pnl(
    orders: DataFrame,
    ads: DataFrame,
    *,
    by: Sequence[str] = (),
    completed: str = COMPLETED,
    unattributed: str = UNATTRIBUTED,
    unique_ids: bool = False,
) -> DataFrame:
    """Profit and loss per day and channel; channel-less orders count as organic."""
    keys = [*by, "date", "channel"]
    sold = (
        completed_only(orders, completed)
        .withColumn("channel", F.coalesce("acquisition_channel", F.lit(unattributed)))
        .withColumnRenamed("order_date", "date")
        .groupBy(*keys)
        .agg(
            orders_counted(unique_ids).alias("n"),
            money_sum("gross_revenue").alias("revenue"),
            money_sum("cogs").alias("goods"),
            money_sum("shipping_cost").alias("shipping"),
            money_sum(F.col("gross_revenue") - F.col("cogs") - F.col("shipping_cost")).alias("profit"),
        )
    )
    spent = (
        ads.withColumnRenamed("ad_date", "date")
        .groupBy(*keys)
        .agg(money_sum("ad_spend").alias("spend"))
    )
    n, revenue, goods, shipping, profit, spend = (
        zero_if_null(F.col(c)) for c in ("n", "revenue", "goods", "shipping", "profit", "spend")
    )
    return sold.join(spent, keys, "full_outer").select(
        *keys,
        n.alias("total_orders"),
        revenue.alias("attributed_revenue"),
        spend.alias("channel_ad_spend"),
        goods.alias("attributed_cogs"),
        shipping.alias("attributed_shipping"),
        (profit - spend).alias("channel_net_profit"),
        ratio_or_zero(revenue, spend).alias("channel_roas"),
        F.when(spend > 0, ratio_or_zero(spend, n)).otherwise(F.lit(0)).alias("channel_cac"),
    )


def channel_profitability(
    orders: DataFrame,
    *,
    by: Sequence[str] = (),
    completed: str = COMPLETED,
    refunded: str = REFUNDED,
    unique_ids: bool = False,
) -> DataFrame:
    """Volume, refunds and margin per channel over orders of every status.

    An order that was not completed still costs its goods and shipping.
    """
    kept = F.col("status") == completed
    cost = F.col("cogs") + F.col("shipping_cost")
    contribution = F.when(kept, F.col("gross_revenue") - cost).otherwise(-cost)
    sums = orders.groupBy(*by, "acquisition_channel").agg(
        orders_counted(unique_ids).alias("total_orders_placed"),
        F.count_if(kept).alias("completed_orders"),
        F.count_if(F.col("status") == refunded).alias("refunded_orders"),
        money_sum("gross_revenue").alias("gross_revenue_volume"),
        money_sum("cogs").alias("total_cogs"),
        money_sum("shipping_cost").alias("total_shipping"),
        money_sum(contribution).alias("total_net_profit"),
    )
    return sums.select(
        *by,
        "acquisition_channel",
        "total_orders_placed",
        "completed_orders",
        "refunded_orders",
        percent_or_null(F.col("refunded_orders"), F.col("total_orders_placed")).alias(
            "refund_rate_pct"
        ),
        "gross_revenue_volume",
        "total_cogs",
        "total_shipping",
        "total_net_profit",
        percent_or_null(F.col("total_net_profit"), F.col("gross_revenue_volume")).alias(
            "net_profit_margin_pct"
        ),
    )


def attribution_share(
    orders: DataFrame,
    *,
    by: Sequence[str] = (),
    completed: str = COMPLETED,
    unique_ids: bool = False,
) -> DataFrame:
    """Orders, revenue, margin, order value and revenue share per channel.

    The store total is a window over the finished channel rows: the orders are
    scanned once, and the window sees one row per channel.
    """
    store = Window.partitionBy(*by)
    per_channel = (
        completed_only(orders, completed)
        .groupBy(*by, "acquisition_channel")
        .agg(
            orders_counted(unique_ids).alias("attributed_orders"),
            money_sum("gross_revenue").alias("attributed_revenue"),
            money_sum("net_margin").alias("attributed_gross_margin"),
            F.count("gross_revenue").alias("_priced"),
        )
    )
    return per_channel.select(
        *by,
        "acquisition_channel",
        "attributed_orders",
        "attributed_revenue",
        "attributed_gross_margin",
        ratio_or_null(F.col("attributed_revenue"), F.col("_priced")).alias("average_order_value"),
        percent_or_null(
            F.col("attributed_revenue"), F.sum("attributed_revenue").over(store)
        ).alias("revenue_share_pct"),
    )


def sales_velocity(
    orders: DataFrame,
    *,
    by: Sequence[str] = (),
    completed: str = COMPLETED,
    unique_ids: bool = False,
) -> DataFrame:
    """Orders per active day and channel, with a speed label on the rounded value."""
    done = completed_only(orders, completed)
    keys = [*by, "acquisition_channel"]
    if unique_ids:
        # Days first: the second grouping then counts a few rows per channel.
        per_day = done.groupBy(*keys, "order_date").agg(
            F.count("order_id").alias("n"), money_sum("gross_revenue").alias("revenue")
        )
        sums = per_day.groupBy(*keys).agg(
            F.sum("n").alias("total_units_sold"),
            F.count("order_date").alias("days"),
            F.sum("revenue").alias("total_channel_revenue"),
        )
    else:
        sums = done.groupBy(*keys).agg(
            F.count_distinct("order_id").alias("total_units_sold"),
            F.count_distinct("order_date").alias("days"),
            money_sum("gross_revenue").alias("total_channel_revenue"),
        )
    velocity = ratio_or_null(F.col("total_units_sold"), F.col("days"))
    return sums.withColumn("daily_burn_velocity", velocity).select(
        *keys,
        "total_units_sold",
        "daily_burn_velocity",
        "total_channel_revenue",
        velocity_label(F.col("daily_burn_velocity")).alias("operational_status"),
    )


def marketing_efficiency(daily: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Daily unit economics under marketing-efficiency names, with the net margin."""
    return daily.select(
        *by,
        "date",
        "total_orders",
        F.col("total_revenue").alias("gross_revenue"),
        "total_ad_spend",
        F.col("net_profit").alias("net_cash_profit"),
        F.col("blended_roas").alias("marketing_efficiency_ratio"),
        "blended_cac",
        percent_or_zero(F.col("net_profit"), F.col("total_revenue")).alias(
            "net_profit_margin_pct"
        ),
    )


def latest_rows(df: DataFrame, order: str, n: int, *, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows with the highest ``order`` (overall, or per ``by`` group)."""
    if not by:
        return df.orderBy(F.col(order).desc_nulls_last()).limit(n)
    newest = Window.partitionBy(*by).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def daily_breakdown(mer: DataFrame, *, days: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """The latest active days behind the macro summary."""
    return latest_rows(mer.where(F.col("gross_revenue") > 0), "date", days, by=by)


def macro_summary(mer: DataFrame, *, days: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Totals, and ratios of totals, over the latest active days."""
    sums = daily_breakdown(mer, days=days, by=by).groupBy(*by).agg(
        zero_if_null(F.sum("gross_revenue")).alias("gross_revenue"),
        zero_if_null(F.sum("total_ad_spend")).alias("total_ad_spend"),
        zero_if_null(F.sum("net_cash_profit")).alias("net_cash_profit"),
        zero_if_null(F.sum("total_orders")).alias("total_orders"),
    )
    revenue, spend = F.col("gross_revenue"), F.col("total_ad_spend")
    return sums.select(
        *by,
        "gross_revenue",
        "total_ad_spend",
        "net_cash_profit",
        "total_orders",
        ratio_or_zero(revenue, spend).alias("marketing_efficiency_ratio"),
        ratio_or_zero(spend, F.col("total_orders")).alias("blended_cac"),
        percent_or_zero(F.col("net_cash_profit"), revenue).alias("net_margin_pct"),
    )


def channel_rollup(pnl: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Channel P&L over all days, with the ROAS of the sums."""
    sums = pnl.groupBy(*by, "channel").agg(
        *[
            F.sum(c).alias(c)
            for c in (
                "total_orders",
                "attributed_revenue",
                "channel_ad_spend",
                "attributed_cogs",
                "channel_net_profit",
            )
        ]
    )
    return sums.withColumn(
        "channel_roas", ratio_or_zero(F.col("attributed_revenue"), F.col("channel_ad_spend"))
    )
