"""Approximate distinct counts from mergeable sketches: opt-in, beside the exact ones.

A day's sketch is a few kilobytes however many customers it saw. Sketches of any
days merge into that of the whole, so windows of any length are answered from
stored days without reading an order again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlake.operators.staging import COMPLETED, completed_only

#: Logarithm of a sketch's registers; the relative standard error is about 1.04 / sqrt(2 ** this).
REGISTERS = 12
ERROR = 1.04 / 2 ** (REGISTERS / 2)


def daily_sketches(
    orders: DataFrame, *, by: Sequence[str] = (), of: str = "customer_id", completed: str = COMPLETED
) -> DataFrame:
    """date, orders, sketch of each day's customers (null ids count as none). Map-side sketches merge in the shuffle."""
    return completed_only(orders, completed).groupBy(*by, F.col("order_date").alias("date")).agg(
        F.count("order_id").alias("orders"), F.hll_sketch_agg(of, REGISTERS).alias("sketch")
    )


def approximate_customers(
    sketches: DataFrame, *, period: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """orders and customers (approximate) over all days, or for each value of ``period``, a column of the days."""
    keys = [*by, *([period] if period is not None else [])]
    merged = sketches.groupBy(*keys).agg(F.sum("orders").alias("orders"), F.hll_union_agg("sketch").alias("_s"))
    return merged.withColumn("customers", F.hll_sketch_estimate("_s")).drop("_s")
