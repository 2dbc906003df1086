"""File sources: ad-spend CSV, order exports, JSON landings, tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginlake import schemas
from marginlake.functions.identity import pseudonym
from marginlake.functions.money import dec
from marginlake.sources.validate import CORRUPT

# Fixed values used where a feed leaves a field out.
STOREFRONT_CHANNEL = "Shopify Web"
AD_PLATFORM_CHANNEL = "Meta Ads"
GUEST = "GUEST"
DEFAULT_SHIPPING = "5.0"
DEFAULT_CAMPAIGN = "default_campaign"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_ad_spend_csv(spark: SparkSession, path: str) -> DataFrame:
    """date, channel, spend, clicks, impressions as text, ready to validate.

    Header row, fixed columns, no inference. A line of other columns is kept
    whole in ``_corrupt_record``, and validation quarantines it.
    """
    cells = T.StructType([T.StructField(f.name, T.StringType()) for f in schemas.AD_SPEND_CSV.fields])
    return (
        spark.read.schema(_with_corrupt(cells))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def read_orders_export(
    spark: SparkSession, path: str, rename: Mapping[str, str] | None = None, *, multi_line: bool = False
) -> DataFrame:
    """An order export as all-string rows under canonical names, ready to validate.

    ``rename`` maps the export's headings to canonical columns; headings that are
    not canonical afterwards are dropped. Absent optional columns stay absent, so
    that validation applies its defaults. A line with more or fewer cells than the
    heading is kept whole in ``_corrupt_record``, and validation quarantines it.
    ``multi_line``: quoted cells may hold line breaks; a file is then read by one task.
    """
    heading = spark.read.option("header", True).csv(path).columns
    cells = T.StructType([T.StructField(c, T.StringType()) for c in heading])
    raw = (
        spark.read.schema(_with_corrupt(cells))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )
    raw = raw.withColumnsRenamed(dict(rename or {}))
    return raw.select(*[f.name for f in schemas.ORDERS.fields if f.name in raw.columns], CORRUPT)


def _read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(_with_corrupt(schema)).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_storefront_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed order pages; what is no JSON is kept in ``_corrupt_record``."""
    return _read_json(spark, path, schemas.STOREFRONT_PAGE)


def read_insights_pages(spark: SparkSession, path: str, *, landed_since: dt.date | None = None) -> DataFrame:
    """Landed insight pages; what is no JSON is kept in ``_corrupt_record``.

    With ``landed_since``, ``path`` has folders ``landed=<date>``, and older ones
    are not read.
    """
    if landed_since is None:
        return _read_json(spark, path, schemas.INSIGHTS_PAGE)
    by_day = T.StructType([*schemas.INSIGHTS_PAGE.fields, T.StructField("landed", T.DateType())])
    return _read_json(spark, path, by_day).where(F.col("landed") >= F.lit(landed_since)).drop("landed")


def _stream_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(_with_corrupt(schema)).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def stream_storefront_pages(spark: SparkSession, path: str) -> DataFrame:
    """Order pages as their files land; what is no JSON is kept in ``_corrupt_record``."""
    return _stream_json(spark, path, schemas.STOREFRONT_PAGE)


def stream_order_events(spark: SparkSession, path: str, arrived: str = "arrived_at") -> DataFrame:
    """Webhook events as their files land, with their arrival time; what is no JSON is kept in ``_corrupt_record``."""
    return _stream_json(spark, path, T.StructType([*schemas.ORDER_EVENT.fields, T.StructField(arrived, T.TimestampType())]))


def _corrupt(df: DataFrame) -> Column:
    return F.col(CORRUPT) if CORRUPT in df.columns else F.lit(None).cast("string")


def _rows_of(pages: DataFrame, items: str) -> DataFrame:
    """A row for each item of a page, and one for each page that is none."""
    kind = pages.schema[items].dataType
    broken = _corrupt(pages)
    all_items = F.when(broken.isNotNull(), F.array(F.lit(None).cast(kind.elementType))).otherwise(F.col(items))
    return pages.select(F.explode(all_items).alias("i"), broken.alias(CORRUPT))


def storefront_orders(pages: DataFrame) -> DataFrame:
    """Storefront order pages as raw order rows: text, ready to validate.

    Works on batch and streaming frames alike. Cost of goods is left to
    validation, which also quarantines amounts and dates that are none.
    """
    o = _rows_of(pages, "orders")
    return o.select(
        F.col("i.id").alias("order_id"),
        F.concat(F.lit("CUST_"), F.coalesce("i.customer.id", F.lit(GUEST))).alias("customer_id"),
        F.col("i.created_at").alias("order_date"),
        F.coalesce("i.total_price", F.lit("0")).alias("gross_revenue"),
        F.coalesce("i.total_shipping_price_set.shop_money.amount", F.lit(DEFAULT_SHIPPING)).alias("shipping_cost"),
        F.coalesce("i.source_name", F.lit(STOREFRONT_CHANNEL)).alias("acquisition_channel"),
        F.when(F.col("i.financial_status") == "refunded", "Refunded").otherwise("Completed").alias("status"),
        CORRUPT,
    )


def ad_insights(
    pages: DataFrame, *, as_of: dt.date, days_back: int = 30, channel: str = AD_PLATFORM_CHANNEL
) -> DataFrame:
    """Daily insights within [as_of - days_back, as_of] as raw ad-spend rows: text, ready to validate.

    Rows whose day cannot be read stay, for the quarantine.
    """
    d = _rows_of(pages, "data")
    day = F.col("i.date_start").try_cast("date")
    inside = day.between(F.lit(as_of - dt.timedelta(days=days_back)), F.lit(as_of))
    return d.where(F.coalesce(inside, F.lit(True))).select(
        F.col("i.date_start").alias("date"),
        F.lit(channel).alias("channel"),
        F.col("i.spend").alias("spend"),
        F.col("i.clicks").alias("clicks"),
        F.col("i.impressions").alias("impressions"),
        CORRUPT,
    )


def order_events(events: DataFrame, *, salt: str, arrived: str | None = None) -> DataFrame:
    """Webhook order events as raw order rows, ready to validate; the customer becomes a pseudonym.

    ``arrived`` names the arrival-time column; without it, arrival is now. An event
    without an order id takes one from its arrival second and a hash of what it says:
    such events are one order only if they say the same in the same second.
    """
    at = F.col(arrived).cast("timestamp") if arrived else F.current_timestamp()
    said = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("customer_id", "gross_revenue")])
    made_up_id = F.concat(F.lit("ORD_"), F.unix_seconds(at).cast("string"), F.lit("_"), F.substring(F.md5(said), 1, 12))
    return events.select(
        F.coalesce("order_id", made_up_id).alias("order_id"),
        pseudonym(F.coalesce("customer_id", F.lit(GUEST)), salt).alias("customer_id"),
        at.alias("order_date"),
        F.coalesce(F.col("gross_revenue").cast("string"), F.lit("0")).alias("gross_revenue"),
        F.lit(DEFAULT_SHIPPING).alias("shipping_cost"),
        F.lit(STOREFRONT_CHANNEL).alias("acquisition_channel"),
        F.lit("Completed").alias("status"),
        *([CORRUPT] if CORRUPT in events.columns else []),
    )


def ad_spend_rows(df: DataFrame) -> DataFrame:
    """Any ad-spend frame under the canonical schema, with a default campaign."""
    out = schemas.conform(df, schemas.AD_SPEND)
    return out.withColumns(
        {
            "campaign_id": F.coalesce("campaign_id", F.lit(DEFAULT_CAMPAIGN)),
            "spend": F.coalesce("spend", dec("0", 12, 2)),
            "impressions": F.coalesce("impressions", F.lit(0)),
            "clicks": F.coalesce("clicks", F.lit(0)),
            "currency": F.coalesce("currency", F.lit("USD")),
        }
    )
