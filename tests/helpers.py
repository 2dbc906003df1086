"""Small frames and plan text for tests."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

ORDER_COLUMNS = (
    "order_id string, customer_id string, order_date timestamp, gross_revenue decimal(12,2), "
    "cogs decimal(12,2), shipping_cost decimal(10,2), acquisition_channel string, status string"
)
AD_COLUMNS = (
    "date date, channel string, spend decimal(12,2), clicks long, impressions long, conversions long"
)


def order(i, customer="c1", day="2025-01-01", revenue="100", cogs="30", ship="5", channel="Meta Ads", status="Completed"):
    at = dt.datetime.fromisoformat(day)
    return (str(i), customer, at, Decimal(revenue), Decimal(cogs), Decimal(ship), channel, status)


def orders_frame(spark, rows):
    return spark.createDataFrame(rows, ORDER_COLUMNS)


def ad(day="2025-01-01", channel="Meta Ads", spend="10", clicks=1, impressions=100, conversions=1):
    return (dt.date.fromisoformat(day), channel, Decimal(spend), clicks, impressions, conversions)


def ads_frame(spark, rows):
    return spark.createDataFrame(rows, AD_COLUMNS)


def dicts(df, *order_by):
    return [r.asDict(recursive=True) for r in (df.orderBy(*order_by) if order_by else df).collect()]


def one(df):
    rows = dicts(df)
    assert len(rows) == 1, rows
    return rows[0]


def column(spark, expr):
    """The value of one column expression over literals."""
    return spark.range(1).select(expr.alias("x")).collect()[0]["x"]


def lits(*values):
    return [F.lit(v) for v in values]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
