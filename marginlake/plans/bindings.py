"""The sample tables seen as orders, ad spend, lines, stock and landing data.

``store_*`` keeps the tables' own seven-year calendar. ``half_year_*`` folds the
same rows into 181 days of 2025, so that recency rules and cohorts have something
to decide. Both use every row. Money is scaled by decimal multiplication only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginlake.functions.money import dec

AS_OF = "2025-07-01 00:00:00"
MID_MONTH = "2025-06-20 12:00:00"
SALT = "salt"
# The years of each file of the live stream; orders of the years before LATE_BEFORE that are late come with the last.
YEARS = ((1990, 1997), (1998, 1999), (2000, 2010))
LATE_BEFORE = 1996
_DAY_ONE = "2025-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _map(c: Column, values: dict[str, str]) -> Column:
    """CASE chain; values not listed give NULL."""
    items = list(values.items())
    out = F.when(c == items[0][0], items[0][1])
    for k, v in items[1:]:
        out = out.when(c == k, v)
    return out


_ORDER_CHANNEL = {
    "1-URGENT": "Meta Ads",
    "2-HIGH": "Google Ads",
    "3-MEDIUM": "TikTok Ads",
    "5-LOW": "Organic / Direct",
}
_AD_CHANNEL = {"A": "Meta Ads", "R": "Google Ads", "N": "TikTok Ads"}
_SHORT_ORDER_CHANNEL = {
    "1-URGENT": "Meta",
    "2-HIGH": "Google",
    "3-MEDIUM": "TikTok",
    "5-LOW": "Organic",
}
_SHORT_AD_CHANNEL = {"A": "Meta", "R": "Google", "N": "TikTok"}


def _workspace(key: str) -> Column:
    return F.concat(F.lit("ws"), (F.col(key) % 4).cast("string")).alias("workspace_id")


def store_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    gross = F.col("o_totalprice").cast("decimal(12,2)")
    return table(spark, sf_dir, "orders").select(
        _workspace("o_custkey"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderdate").cast("timestamp").alias("order_date"),
        gross.alias("gross_revenue"),
        F.round(gross * dec("0.35", 3, 2), 2).cast("decimal(12,2)").alias("cogs"),
        F.lit(5).cast("decimal(10,2)").alias("shipping_cost"),
        _map(F.col("o_orderpriority"), _ORDER_CHANNEL).alias("acquisition_channel"),
        F.when(F.col("o_orderstatus") == "P", "Refunded").otherwise("Completed").alias("status"),
    )


def store_ad_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    spend = F.round(price * F.col("l_discount").cast("decimal(4,2)"), 2)
    return table(spark, sf_dir, "lineitem").select(
        _workspace("l_suppkey"),
        F.col("l_shipdate").cast("date").alias("date"),
        _map(F.col("l_returnflag"), _AD_CHANNEL).alias("channel"),
        F.col("l_suppkey").cast("string").alias("campaign_id"),
        spend.cast("decimal(12,2)").alias("spend"),
        (F.col("l_quantity") * 100).cast("long").alias("impressions"),
        F.col("l_quantity").cast("long").alias("clicks"),
    )


def _folded_day(n: Column) -> Column:
    return F.date_add(F.lit(_DAY_ONE).cast("date"), n.cast("int")).cast("timestamp")


def half_year_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    gross = F.round(
        F.col("o_totalprice").cast("decimal(12,2)") * dec("0.001", 4, 3), 2
    ).cast("decimal(12,2)")
    return table(spark, sf_dir, "orders").select(
        _workspace("o_custkey"),
        key.cast("string").alias("order_id"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("-"), (key % 8).cast("string")).alias(
            "customer_id"
        ),
        _folded_day(key * 7 % 181).alias("order_date"),
        gross.alias("gross_revenue"),
        F.round(gross * dec("0.35", 3, 2), 2).cast("decimal(12,2)").alias("cogs"),
        F.lit(5).cast("decimal(10,2)").alias("shipping_cost"),
        _map(F.col("o_orderpriority"), _SHORT_ORDER_CHANNEL).alias("acquisition_channel"),
        F.when(F.col("o_orderstatus") == "P", "refunded").otherwise("paid").alias("status"),
    )


def half_year_ad_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    spend = price * F.col("l_discount").cast("decimal(4,2)") * dec("0.01", 3, 2)
    return table(spark, sf_dir, "lineitem").select(
        _workspace("l_suppkey"),
        _folded_day(F.col("l_orderkey") % 181).alias("date"),
        _map(F.col("l_returnflag"), _SHORT_AD_CHANNEL).alias("channel"),
        F.round(spend, 2).cast("decimal(12,2)").alias("spend"),
        (F.col("l_quantity") * 100).cast("long").alias("impressions"),
        F.col("l_quantity").cast("long").alias("clicks"),
        F.col("l_linenumber").cast("long").alias("conversions"),
    )


def landing_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store orders with landing URL, UTM source and tags."""
    key = F.col("order_id").cast("long")
    text = key.cast("string")
    page = "https://shop.example/p"
    slot = key % 10
    url = (
        F.when(slot == 0, F.concat(F.lit(f"{page}?fbclid=IwAR"), text))
        .when(slot == 1, F.concat(F.lit(f"{page}?utm_medium=cpc&gclid=Cj_"), text))
        .when(slot == 2, f"{page}?wbraid=Zz9")
        .when(slot == 3, F.concat(F.lit(f"{page}?ttclid=T-"), text))
        .when(slot < 9, page)
    )
    source = (
        F.when(slot < 4, "")
        .when(slot == 4, "Instagram")
        .when(slot == 5, "youtube")
        .when(slot == 6, "klaviyo")
        .when(slot == 7, "campaign_x")
        .when(slot == 8, "tiktok_ads")
    )
    tags = F.when(key % 13 == 0, "FBA,priority").when(key % 17 != 0, "retail")
    return store_orders(spark, sf_dir).withColumns(
        {"landing_url": url, "utm_source": source, "order_tags": tags}
    )


def foreign_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store orders in eight currency spellings, two of them untidy or unknown."""
    codes = F.array(*[F.lit(c) for c in ("USD", "EUR", "GBP", "CAD", "AUD", "INR", " eur ", "XXX")])
    slot = (F.col("order_id").cast("long") % 8).cast("int") + 1
    return store_orders(spark, sf_dir).withColumn("currency", F.element_at(codes, slot))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    revenue = F.col("l_extendedprice").cast("decimal(12,2)")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_partkey").cast("string").alias("sku"),
        F.col("l_shipdate").cast("date").alias("line_date"),
        F.col("l_quantity").cast("long").alias("units"),
        revenue.alias("line_revenue"),
        F.round(revenue * dec("0.35", 3, 2), 2).cast("decimal(12,2)").alias("line_cogs"),
        (F.col("l_returnflag") == "R").alias("returned"),
    )


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("sku"),
        (F.col("p_size").cast("long") * 10).alias("on_hand"),
    )


def raw_order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store orders as an all-text feed in which some cells went wrong."""
    key = F.col("order_id").cast("long")
    o = store_orders(spark, sf_dir)
    return o.select(
        "order_id",
        "customer_id",
        F.when(key % 103 == 0, "someday")
        .otherwise(F.date_format("order_date", "yyyy-MM-dd HH:mm:ss"))
        .alias("order_date"),
        F.when(key % 101 == 0, "ten")
        .otherwise(F.col("gross_revenue").cast("string"))
        .alias("gross_revenue"),
        F.when(key % 7 == 0, "nan").otherwise(F.col("cogs").cast("string")).alias("cogs"),
        "acquisition_channel",
        "status",
    )


def billing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as billing webhooks, as JSON text with its arrival time.

    Users buy under two billing customers each, and share them with neighbours.
    """
    user = F.col("user_id").cast("string")
    kind = (
        F.when(F.col("event_type") == "signup", "checkout.session.completed")
        .when(F.col("event_type") == "error", "customer.subscription.deleted")
        .otherwise(F.col("event_type"))
    )
    is_checkout = F.col("event_type") == "signup"
    even = F.col("event_id") % 2 == 0
    body = F.struct(
        kind.alias("type"),
        F.struct(
            F.struct(
                F.concat(F.lit("cs_"), F.col("event_id").cast("string")).alias("id"),
                F.struct(
                    F.when(is_checkout, user).alias("userId"),
                    F.when(is_checkout & even, "enterprise").alias("plan"),
                ).alias("metadata"),
                F.concat(F.lit("cus_"), (F.col("user_id") + F.col("event_id") % 2).cast("string")).alias("customer"),
                F.when(even, (F.col("value") * 100).cast("long")).alias("amount_total"),
            ).alias("object")
        ).alias("data"),
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("received_at"),
        F.to_json(body).alias("body"),
    )
