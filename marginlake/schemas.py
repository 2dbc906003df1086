"""Canonical schemas shared by all sources, marts and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("order_date", T.TimestampType()),
        T.StructField("gross_revenue", T.DecimalType(12, 2)),
        T.StructField("cogs", T.DecimalType(12, 2)),
        T.StructField("shipping_cost", T.DecimalType(10, 2)),
        T.StructField("taxes", T.DecimalType(10, 2)),
        T.StructField("discounts", T.DecimalType(10, 2)),
        T.StructField("acquisition_channel", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("landing_site", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# The columns a conflicting order may change, and those that keep their first value.
ORDER_MUTABLE = (
    "status",
    "gross_revenue",
    "cogs",
    "shipping_cost",
    "taxes",
    "discounts",
    "acquisition_channel",
)
ORDER_IMMUTABLE = ("customer_id", "order_date", "landing_site", "currency", "created_at")

AD_SPEND = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("channel", T.StringType()),
        T.StructField("campaign_id", T.StringType()),
        T.StructField("campaign_name", T.StringType()),
        T.StructField("spend", T.DecimalType(12, 2)),
        T.StructField("impressions", T.LongType()),
        T.StructField("clicks", T.LongType()),
        T.StructField("conversions", T.LongType()),
        T.StructField("currency", T.StringType()),
    ]
)

AD_SPEND_KEY = ("date", "channel", "campaign_id")

# The ad-spend file as exported: header row, five columns.
AD_SPEND_CSV = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("channel", T.StringType()),
        T.StructField("spend", T.DecimalType(12, 2)),
        T.StructField("clicks", T.LongType()),
        T.StructField("impressions", T.LongType()),
    ]
)

DLQ = T.StructType(
    [
        T.StructField("source_system", T.StringType()),
        T.StructField("raw_payload", T.StringType()),
        T.StructField("error_reason", T.StringType()),
        T.StructField("failed_at", T.TimestampType()),
    ]
)

ALERTS = T.StructType(
    [
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("action", T.StringType()),
    ]
)

# Storefront order feed: one document holds a page of orders.
STOREFRONT_PAGE = T.StructType(
    [
        T.StructField(
            "orders",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField(
                            "customer", T.StructType([T.StructField("id", T.StringType())])
                        ),
                        T.StructField("total_price", T.StringType()),
                        T.StructField("created_at", T.StringType()),
                        T.StructField(
                            "total_shipping_price_set",
                            T.StructType(
                                [
                                    T.StructField(
                                        "shop_money",
                                        T.StructType([T.StructField("amount", T.StringType())]),
                                    )
                                ]
                            ),
                        ),
                        T.StructField("source_name", T.StringType()),
                        T.StructField("financial_status", T.StringType()),
                    ]
                )
            ),
        )
    ]
)

# Ad-platform daily insights: one document holds the days of a window.
INSIGHTS_PAGE = T.StructType(
    [
        T.StructField(
            "data",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("date_start", T.StringType()),
                        T.StructField("spend", T.StringType()),
                        T.StructField("impressions", T.StringType()),
                        T.StructField("clicks", T.StringType()),
                    ]
                )
            ),
        )
    ]
)

# Order webhook body.
ORDER_EVENT = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("gross_revenue", T.StringType()),
    ]
)

# Billing webhook body.
BILLING_EVENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField(
                        "object",
                        T.StructType(
                            [
                                T.StructField("id", T.StringType()),
                                T.StructField(
                                    "metadata",
                                    T.StructType(
                                        [
                                            T.StructField("userId", T.StringType()),
                                            T.StructField("plan", T.StringType()),
                                        ]
                                    ),
                                ),
                                T.StructField("client_reference_id", T.StringType()),
                                T.StructField("customer", T.StringType()),
                                T.StructField("subscription", T.StringType()),
                                T.StructField("amount_total", T.LongType()),
                                T.StructField("currency", T.StringType()),
                                T.StructField("payment_status", T.StringType()),
                            ]
                        ),
                    )
                ]
            ),
        ),
    ]
)


def conform(df: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project ``df`` onto ``schema``: cast what exists, NULL what does not."""

    def field(f: T.StructField) -> Column:
        source = F.col(f.name) if f.name in df.columns else F.lit(None)
        return source.cast(f.dataType).alias(f.name)

    return df.select(*keep, *[field(f) for f in schema.fields])


def workspace_orders(df: DataFrame) -> DataFrame:
    """Workspace ``orders`` (user_id, revenue, shipping, ...) as canonical orders.

    Statuses keep their own words (``paid``/``refunded``): operators take the
    completed status as a parameter.
    """
    return df.select(
        F.col("user_id").cast("string").alias("workspace_id"),
        F.col("order_number").alias("order_id"),
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("created_at").cast("timestamp").alias("order_date"),
        F.col("revenue").cast("decimal(12,2)").alias("gross_revenue"),
        F.col("cogs").cast("decimal(12,2)").alias("cogs"),
        F.col("shipping").cast("decimal(10,2)").alias("shipping_cost"),
        F.col("channel").alias("acquisition_channel"),
        "status",
    )


def workspace_ad_spend(df: DataFrame) -> DataFrame:
    """Workspace ``ad_spend`` as canonical ad spend; ``date`` keeps its time of day."""
    return df.select(
        F.col("user_id").cast("string").alias("workspace_id"),
        F.col("date").cast("timestamp").alias("date"),
        "channel",
        F.col("spend").cast("decimal(12,2)").alias("spend"),
        F.col("impressions").cast("long").alias("impressions"),
        F.col("clicks").cast("long").alias("clicks"),
        F.col("conversions").cast("long").alias("conversions"),
    )
