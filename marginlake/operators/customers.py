"""Customer lifetime value, cohorts, repeat cycles and segments.

Hot customers: every per-customer step either aggregates with a map-side combine
or keeps the first few rows per customer, so no task receives all rows of one
customer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginlake.functions.calendar import month_index, month_of, months_between, recency_days
from marginlake.functions.money import money_sum, percent_or_null, ratio_or_null
from marginlake.functions.segments import loyalty_tier, rfm_segment, segment_label, segment_rank
from marginlake.functions.text import month_label
from marginlake.operators.staging import COMPLETED, completed_only, orders_counted


def customer_ltv(
    orders: DataFrame,
    *,
    by: Sequence[str] = (),
    completed: str = COMPLETED,
    unique_ids: bool = False,
) -> DataFrame:
    """First and last order, order count, revenue, margin and loyalty tier per customer."""
    sums = (
        completed_only(orders, completed)
        .groupBy(*by, "customer_id")
        .agg(
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
            orders_counted(unique_ids).alias("total_lifetime_orders"),
            money_sum("gross_revenue").alias("lifetime_revenue"),
            money_sum("net_margin").alias("lifetime_net_margin"),
        )
    )
    return sums.withColumn("customer_segment", loyalty_tier(F.col("total_lifetime_orders")))


def tier_revenue_share(ltv: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Customers, revenue and revenue share per loyalty tier (at most three rows)."""
    sums = ltv.groupBy(*by, "customer_segment").agg(
        F.count(F.lit(1)).alias("customers"), money_sum("lifetime_revenue").alias("revenue")
    )
    total = F.sum("revenue").over(Window.partitionBy(*by))
    return sums.withColumn("revenue_share_pct", percent_or_null(F.col("revenue"), total))


def cohort_retention(
    orders: DataFrame, *, by: Sequence[str] = (), completed: str = COMPLETED
) -> DataFrame:
    """Active customers, revenue and profit per first-order month and month number.

    Orders collapse to one row per customer and month before the shuffle on
    customer, where the earliest month is the cohort: the window then holds one
    row per active month. Months without orders have no row.
    """
    customer = [*by, "customer_id"]
    monthly = (
        completed_only(orders, completed)
        .where(F.col("customer_id").isNotNull())
        .groupBy(*customer, month_of(F.col("order_date")).alias("month"))
        .agg(money_sum("gross_revenue").alias("revenue"), money_sum("net_margin").alias("profit"))
        .withColumn("cohort_month", F.min("month").over(Window.partitionBy(*customer)))
    )
    cohorts = (
        monthly.withColumn("month_number", months_between(F.col("month"), F.col("cohort_month")))
        .groupBy(*by, "cohort_month", "month_number")
        .agg(
            F.count(F.lit(1)).alias("active_customers"),
            money_sum("revenue").alias("cohort_revenue"),
            money_sum("profit").alias("cohort_net_profit"),
        )
    )
    start = Window.partitionBy(*by, "cohort_month").orderBy("month_number")
    return cohorts.withColumn(
        "initial_cohort_size", F.first("active_customers").over(start)
    ).withColumn(
        "retention_rate_pct",
        percent_or_null(F.col("active_customers"), F.col("initial_cohort_size")),
    )


def _nth_orders(
    orders: DataFrame, limit: int, by: Sequence[str], completed: str
) -> DataFrame:
    """The first ``limit`` orders of each customer, numbered from 1.

    Catalyst plans the filter as a rank limit on both sides of the shuffle: at
    most ``limit`` rows per customer leave each input task.
    """
    sequence = Window.partitionBy(*by, "customer_id").orderBy(
        "order_date", "order_timestamp", "order_id"
    )
    return (
        completed_only(orders, completed)
        .withColumn("nth", F.row_number().over(sequence))
        .where(F.col("nth") <= limit)
    )


def cycle_churn(
    orders: DataFrame, *, by: Sequence[str] = (), completed: str = COMPLETED, cycles: int = 6
) -> DataFrame:
    """Customers reaching their n-th order, retention against the first, churn per step."""
    # A customer has each order number once, so a plain count is a distinct count.
    per_cycle = (
        _nth_orders(orders, cycles, by, completed)
        .groupBy(*by, F.col("nth").alias("subscription_cycle"))
        .agg(
            F.count("customer_id").alias("active_subscribers"),
            money_sum("gross_revenue").alias("cycle_gross_revenue"),
            F.count("gross_revenue").alias("_priced"),
        )
    )
    steps = Window.partitionBy(*by).orderBy("subscription_cycle")
    active = F.col("active_subscribers")
    kept = percent_or_null(active, F.lag(active, 1).over(steps), scale=8)
    return per_cycle.select(
        *by,
        "subscription_cycle",
        "active_subscribers",
        "cycle_gross_revenue",
        ratio_or_null(F.col("cycle_gross_revenue"), F.col("_priced")).alias("average_cycle_value"),
        percent_or_null(active, F.first(active).over(steps)).alias("cycle_retention_pct"),
        F.round(F.lit(100) - kept, 2).alias("cycle_churn_rate_pct"),
    )


def repurchase_windows(
    orders: DataFrame,
    *,
    by: Sequence[str] = (),
    completed: str = COMPLETED,
    windows: Sequence[int] = (30, 60, 90),
) -> DataFrame:
    """Share of each monthly cohort with a second order within 30/60/90 days of the first."""
    customer = [*by, "customer_id"]

    def date_of(n: int) -> Column:
        return F.min(F.when(F.col("nth") == n, F.col("order_date")))

    pairs = (
        _nth_orders(orders, 2, by, completed)
        .where(F.col("customer_id").isNotNull())
        .groupBy(*customer)
        .agg(date_of(1).alias("first"), date_of(2).alias("second"))
    )
    gap = F.date_diff("second", "first")
    sums = pairs.groupBy(*by, month_of(F.col("first")).alias("cohort_month")).agg(
        F.count(F.lit(1)).alias("customers"),
        *[F.count_if(gap <= d).alias(f"repurchased_{d}d") for d in windows],
    )
    return sums.withColumns(
        {
            f"repurchase_{d}d_pct": percent_or_null(F.col(f"repurchased_{d}d"), F.col("customers"))
            for d in windows
        }
    )


def customer_rollup(
    orders: DataFrame, *, by: Sequence[str] = (), completed: str = "paid"
) -> DataFrame:
    """Customers from raw orders: span over all orders, count and spend over paid ones."""
    paid = F.col("status") == completed
    return (
        orders.where(F.col("customer_id").isNotNull())
        .groupBy(*by, "customer_id")
        .agg(
            F.min("order_date").alias("first_order_at"),
            F.max("order_date").alias("last_order_at"),
            F.count_if(paid).alias("order_count"),
            F.coalesce(
                money_sum(F.when(paid, F.col("gross_revenue"))),
                F.lit(0).cast("decimal(20,2)"),
            ).alias("total_spend"),
        )
    )


def segment_customers(customers: DataFrame, *, as_of: Column) -> DataFrame:
    """Add recency, segment and its label, computed at ``as_of``."""
    recency = recency_days(as_of, F.col("last_order_at"))
    return (
        customers.withColumn("recency_days", recency)
        .withColumn(
            "segment",
            rfm_segment(F.col("order_count"), F.col("total_spend"), F.col("recency_days")),
        )
        .withColumn("segment_label", segment_label(F.col("segment")))
    )


def segment_summary(segmented: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Customers, spend and share per segment; ``position`` is the display order."""
    sums = segmented.groupBy(*by, "segment").agg(
        F.count(F.lit(1)).alias("customers"),
        money_sum("total_spend").alias("total_spend"),
        F.sum("order_count").alias("_orders"),
    )
    n = F.col("customers").cast("double")
    everyone = F.sum("customers").over(Window.partitionBy(*by)).cast("double")
    return sums.select(
        *by,
        segment_rank(F.col("segment")).alias("position"),
        "segment",
        segment_label(F.col("segment")).alias("label"),
        "customers",
        "total_spend",
        (F.col("total_spend").cast("double") / n).alias("avg_spend"),
        (F.col("_orders").cast("double") / n).alias("avg_orders"),
        (n / everyone * 100.0).alias("share_pct"),
    )


def customer_kpis(segmented: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Customer count, average lifetime value and VIP count."""
    sums = segmented.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_customers"),
        money_sum("total_spend").alias("_spend"),
        F.count_if(F.col("segment") == "vip").alias("vip_customers"),
    )
    n = F.col("total_customers").cast("double")
    return sums.select(
        *by,
        "total_customers",
        F.coalesce(F.col("_spend").cast("double") / F.nullif(n, F.lit(0.0)), F.lit(0.0)).alias(
            "average_ltv"
        ),
        "vip_customers",
    )


def top_customers(segmented: DataFrame, n: int = 60) -> DataFrame:
    """The ``n`` biggest spenders; ties go to the lower id so that the cut is stable."""
    return segmented.orderBy(F.col("total_spend").desc_nulls_last(), "customer_id").limit(n)


COHORT_COLUMNS = 6


def cohort_matrix(
    customers: DataFrame,
    orders: DataFrame,
    *,
    by: Sequence[str] = (),
    completed: str = "paid",
    width: int = COHORT_COLUMNS,
) -> DataFrame:
    """Share of each first-order month with a paid order k months later, k = 0..5.

    Orders shrink to distinct (customer, month) before they meet the customers, so
    each pair counts at most once. Columns: cohort_month, label, size, values[k].
    """
    customer = [*by, "customer_id"]
    months = (
        orders.where(F.col("customer_id").isNotNull() & (F.col("status") == completed))
        .select(*customer, month_index(F.col("order_date")).alias("month"))
        .distinct()
    )
    joined = customers.select(
        *customer, month_of(F.col("first_order_at")).cast("date").alias("cohort_month")
    ).join(months, customer, "left")
    offset = F.col("month") - month_index(F.col("cohort_month"))
    # One row per customer carries the size; further months add to their offset.
    per_customer = joined.groupBy(*customer, "cohort_month").agg(
        *[F.count_if(offset == k).alias(f"m{k}") for k in range(width)]
    )
    sums = per_customer.groupBy(*by, "cohort_month").agg(
        F.count(F.lit(1)).alias("size"), *[F.sum(f"m{k}").alias(f"m{k}") for k in range(width)]
    )
    return _matrix(sums, by, width)


def cohort_matrix_of_orders(
    orders: DataFrame, *, by: Sequence[str] = (), completed: str = "paid", width: int = COHORT_COLUMNS
) -> DataFrame:
    """The same matrix from one pass: orders shrink to customer-months, whose earliest is the cohort."""
    customer = [*by, "customer_id"]
    monthly = (
        orders.where(F.col("customer_id").isNotNull())
        .groupBy(*customer, month_of(F.col("order_date")).cast("date").alias("month"))
        .agg(F.max(F.col("status") == completed).alias("paid"))
        .withColumn("cohort_month", F.min("month").over(Window.partitionBy(*customer)))
    )
    offset = month_index(F.col("month")) - month_index(F.col("cohort_month"))
    sums = monthly.groupBy(*by, "cohort_month").agg(
        F.count_if(offset == 0).alias("size"),  # every customer has its cohort's month once
        *[F.count_if((offset == k) & F.col("paid")).alias(f"m{k}") for k in range(width)],
    )
    return _matrix(sums, by, width)


def _matrix(sums: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    values = [
        percent_or_null(F.col(f"m{k}"), F.col("size"), scale=1).cast("double") for k in range(width)
    ]
    return sums.select(
        *by,
        "cohort_month",
        month_label(F.col("cohort_month")).alias("label"),
        "size",
        F.array(*values).alias("values"),
    )


def cohort_columns(matrix: DataFrame, width: int = COHORT_COLUMNS) -> DataFrame:
    """The matrix with M0..M5 as columns instead of one array."""
    rest = [c for c in matrix.columns if c != "values"]
    return matrix.select(*rest, *[F.col("values")[k].alias(f"m{k}") for k in range(width)])


def latest_cohorts(matrix: DataFrame, n: int = 6) -> DataFrame:
    return matrix.orderBy(F.col("cohort_month").desc()).limit(n)


def latest_returning_cohort(matrix: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """The newest cohort that has repeat orders in its first following month."""
    row = F.struct("cohort_month", "label", F.col("values")[1].alias("m1"))
    newest = (
        matrix.where(F.col("values")[1] > 0)
        .groupBy(*by)
        .agg(F.max_by(row, F.col("cohort_month")).alias("c"))
    )
    # Without groups the aggregate yields one row even over no cohorts at all.
    return newest.where(F.col("c").isNotNull()).select(*by, "c.*")
