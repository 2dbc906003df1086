"""Staged orders and ad spend: typed, renamed, with the per-order margin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlake.functions.money import MONEY, SMALL_MONEY

COMPLETED = "Completed"
REFUNDED = "Refunded"
UNATTRIBUTED = "Organic / Direct"


def stage_orders(
    raw: DataFrame, *, completed: str = COMPLETED, by: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Typed orders, as wide as validation lets amounts in. The margin is taken from the raw amounts."""
    done = F.col("status") == completed
    margin = F.col("gross_revenue") - F.col("cogs") - F.col("shipping_cost")
    return raw.select(
        *by,
        *keep,
        "order_id",
        "customer_id",
        F.col("order_date").cast("timestamp").alias("order_timestamp"),
        F.col("order_date").cast("date").alias("order_date"),
        F.col("gross_revenue").cast(MONEY).alias("gross_revenue"),
        F.col("cogs").cast(MONEY).alias("cogs"),
        F.col("shipping_cost").cast(SMALL_MONEY).alias("shipping_cost"),
        "acquisition_channel",
        "status",
        F.when(done, 1).otherwise(0).alias("is_completed_order"),
        F.when(done, margin).otherwise(F.lit(0)).alias("net_margin"),
    )


def stage_ad_spend(raw: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    return raw.select(
        *by,
        F.col("date").cast("date").alias("ad_date"),
        "channel",
        F.col("spend").cast(MONEY).alias("ad_spend"),
        "clicks",
        "impressions",
    )


def completed_only(staged: DataFrame, completed: str = COMPLETED) -> DataFrame:
    return staged.where(F.col("status") == completed)


def active_days(daily: DataFrame, revenue: str = "total_revenue") -> DataFrame:
    """Days that sold anything."""
    return daily.where(F.col(revenue) > 0)


def for_workspace(df: DataFrame, workspace: str, key: str = "workspace_id") -> DataFrame:
    """One tenant's rows; a plain equality, so partitions and row groups are pruned."""
    return df.where(F.col(key) == workspace)


def orders_counted(unique_ids: bool) -> Column:
    """Number of orders.

    ``unique_ids=True`` says that order ids are unique, as the keyed merge leaves
    them: counting then needs no shuffle of the ids. Otherwise ids are counted
    exactly once each, at the price of one shuffle on (group, id).
    """
    return F.count("order_id") if unique_ids else F.count_distinct("order_id")
