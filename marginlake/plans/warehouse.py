"""The marts as named SQL views over raw orders and ad spend."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginlake.operators import customers, marts, staging
from marginlake.operators.positions import numbered
from marginlake.session import work_dir


def mart_frames(
    raw_orders: DataFrame, raw_ad_spend: DataFrame, *, unique_ids: bool = False
) -> dict[str, DataFrame]:
    """View name -> lazy frame. Nothing runs until a view is read."""
    o = staging.stage_orders(raw_orders)
    a = staging.stage_ad_spend(raw_ad_spend)
    daily = marts.daily_unit_economics(o, a, unique_ids=unique_ids)
    return {
        "stg_orders": o,
        "stg_ad_spend": a,
        "fct_daily_unit_economics": daily,
        "fct_channel_attributed_pnl": marts.channel_pnl(o, a, unique_ids=unique_ids),
        "fct_product_profitability": marts.channel_profitability(o, unique_ids=unique_ids),
        "fct_multi_touch_attribution": marts.attribution_share(o, unique_ids=unique_ids),
        "fct_inventory_runway": marts.sales_velocity(o, unique_ids=unique_ids),
        "fct_customer_cohort_retention": customers.cohort_retention(o),
        "fct_subscription_churn_velocity": customers.cycle_churn(o),
        "fct_marketing_efficiency_ratio": marts.marketing_efficiency(daily),
        "dim_customer_ltv": customers.customer_ltv(o, unique_ids=unique_ids),
    }


def register_views(
    raw_orders: DataFrame, raw_ad_spend: DataFrame, *, unique_ids: bool = False
) -> list[str]:
    """Create or replace the temporary views; returns their names."""
    frames = mart_frames(raw_orders, raw_ad_spend, unique_ids=unique_ids)
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return list(frames)


# Presentation order of each mart. Stored marts stay unsorted.
ORDERINGS: dict[str, list[tuple[str, bool]]] = {
    "fct_daily_unit_economics": [("date", False)],
    "fct_channel_attributed_pnl": [("date", False), ("channel_net_profit", False)],
    "fct_product_profitability": [("total_net_profit", False)],
    "fct_multi_touch_attribution": [("attributed_revenue", False)],
    "fct_inventory_runway": [("daily_burn_velocity", False)],
    "dim_customer_ltv": [("lifetime_revenue", False)],
    "fct_customer_cohort_retention": [("cohort_month", False), ("month_number", True)],
    "fct_subscription_churn_velocity": [("subscription_cycle", True)],
    "channel_rollup": [("channel_net_profit", False)],
}


def presented(name: str, df: DataFrame) -> DataFrame:
    """The mart in its report order, NULLs last."""
    return df.orderBy(
        *[
            df[c].asc_nulls_last() if ascending else df[c].desc_nulls_last()
            for c, ascending in ORDERINGS[name]
        ]
    )


# What tells rows apart that are equal in a mart's order.
TIES = {
    "fct_channel_attributed_pnl": "channel",
    "fct_product_profitability": "acquisition_channel",
    "fct_multi_touch_attribution": "acquisition_channel",
    "fct_inventory_runway": "acquisition_channel",
    "dim_customer_ltv": "customer_id",
    "channel_rollup": "channel",
}


def _rank(df: DataFrame, column: str, ascending: bool) -> Column:
    """A number that grows along the order of ``column``, whatever its type."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.DateType):
        c = F.datediff(c, F.lit("1970-01-01").cast("date"))
    c = c.cast("decimal(28,4)")
    return c if ascending else -c


def ordered_marts(frames: dict[str, DataFrame]) -> DataFrame:
    """All rows of the marts with their place in the mart's order: mart, position, key, value.

    ``key`` is the tie-breaker's text, ``value`` that of the leading column. All
    marts are one table of sort keys, numbered by one range sort; a mart's
    positions count from its first one. No task holds a mart.
    """
    parts = []
    for name, order in ORDERINGS.items():
        df, lead = frames[name], order[0][0]
        ranks = [_rank(df, c, ascending) for c, ascending in order] + [F.lit(None).cast("decimal(28,4)")]
        is_day = isinstance(df.schema[lead].dataType, T.DateType)
        value = F.date_format(lead, "yyyy-MM-dd") if is_day else F.col(lead).cast("decimal(20,2)").cast("string")
        tie = F.col(TIES[name]).cast("string") if name in TIES else F.lit(None).cast("string")
        parts.append(df.select(F.lit(name).alias("mart"), ranks[0].alias("r1"), ranks[1].alias("r2"), tie.alias("key"), value.alias("value")))
    rows = reduce(DataFrame.unionByName, parts)
    path = work_dir(rows.sparkSession, "mart-orders")
    rows.write.parquet(path)  # the marts are computed once, the sort reads them twice
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    order = [F.col("mart").asc(), F.col("r1").asc_nulls_last(), F.col("r2").asc_nulls_last(), F.col("key").asc_nulls_last()]
    placed = numbered(rows, order)
    firsts = placed.groupBy("mart").agg(F.min("position").alias("_first"))  # one row a mart
    return placed.join(firsts, "mart").select("mart", (F.col("position") - F.col("_first") + 1).alias("position"), "key", "value")
