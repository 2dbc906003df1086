"""What the physical plans must look like for the marts to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from marginlake.functions.calendar import moment
from marginlake.operators import customers, kpis, logs, marts, skus, staging
from marginlake.plans import bindings
from marginlake.plans.queries import QUERIES
from tests.helpers import dicts, plan_of


@pytest.fixture(scope="module")
def store(spark, sf, tmp_path_factory):
    """Canonical Parquet tables, as a deployment would hold them."""
    folder = tmp_path_factory.mktemp("store")
    bindings.store_orders(spark, sf).write.parquet(str(folder / "orders"))
    bindings.store_ad_spend(spark, sf).withColumn("conversions", F.lit(0)).write.parquet(str(folder / "ads"))
    return (spark.read.parquet(str(folder / "orders")), spark.read.parquet(str(folder / "ads")))


def scans(plan):
    return re.findall(r"FileScan parquet.*", plan)


def test_filter_and_columns_reach_the_scan(store):
    o, a = staging.stage_orders(store[0]), staging.stage_ad_spend(store[1])
    plan = plan_of(marts.daily_unit_economics(o, a))
    orders, ads = scans(plan)
    assert "EqualTo(status,Completed)" in orders
    assert "customer_id" not in orders and "acquisition_channel" not in orders
    assert "clicks" not in ads and "channel" not in ads.split("ReadSchema")[1]


def test_unique_ids_need_no_id_shuffle(store):
    o, a = staging.stage_orders(store[0]), staging.stage_ad_spend(store[1])
    exact = plan_of(marts.daily_unit_economics(o, a))
    keyed = plan_of(marts.daily_unit_economics(o, a, unique_ids=True))
    assert re.search(r"hashpartitioning\(date#\d+, order_id", exact)
    assert "order_id" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", keyed))
    assert keyed.count("Exchange") == 2


def test_rank_limits_run_before_the_shuffle(store):
    cycles = plan_of(customers.cycle_churn(staging.stage_orders(store[0])))
    latest = plan_of(logs.latest_per_key(store[0], "customer_id", "order_date", 3, tie=["order_id"]))
    for plan in (cycles, latest):
        assert "WindowGroupLimit" in plan and "Partial" in plan and "Final" in plan


def test_cohorts_window_over_months_not_orders(store):
    plan = plan_of(customers.cohort_retention(staging.stage_orders(store[0])))
    below = plan.split("Window [min(month")[1]
    assert below.index("HashAggregate(keys=[customer_id") < below.index("FileScan")


def test_top_customers_is_a_top_k(store):
    rolled = customers.customer_rollup(store[0], completed="Completed")
    seg = customers.segment_customers(rolled, as_of=moment("2025-07-01"))
    assert "TakeOrderedAndProject(limit=60" in plan_of(customers.top_customers(seg))


def test_trend_window_is_pushed_down(store):
    plan = plan_of(kpis.daily_trend(*store, as_of="2001-07-01 00:00:00", completed="Completed"))
    orders, ads = scans(plan)
    assert "GreaterThanOrEqual(order_date" in orders and "LessThan(order_date" in orders
    assert "GreaterThanOrEqual(date" in ads


def test_workspace_filter_is_pushed_down(store):
    assert "EqualTo(workspace_id,ws1)" in plan_of(staging.for_workspace(store[0], "ws1"))


def test_overview_scans_each_table_once(store):
    plan = plan_of(kpis.overview(*store, as_of="2001-07-01", completed="Completed"))
    assert len(scans(plan)) == 2


@pytest.mark.parametrize("name", ["h7_attribution", "h9_fx", "h10_pseudonym", "a8_good_orders", "b1_stg_orders"])
def test_row_functions_neither_shuffle_nor_leave_the_jvm(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[0] in "bdfghx"))
def test_no_query_pairs_rows_or_runs_python(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "Python" not in plan
    # The one nested loop allowed joins two global aggregates: one row each.
    for part in plan.split("BroadcastNestedLoopJoin")[1:]:
        assert name.startswith(("d12", "d13", "d14", "d15", "d19", "f5", "g3", "g6", "g8"))


def test_hot_customer_and_day(spark):
    """A third of all orders on one customer and one day; results stay whole."""
    n = 30_000
    hot = F.col("id") % 3 == 0
    raw = spark.range(n).select(
        F.col("id").cast("string").alias("order_id"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 5000).cast("string"))).alias("customer_id"),
        F.when(hot, F.lit("2025-03-01").cast("timestamp"))
        .otherwise(F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 90).cast("int")).cast("timestamp"))
        .alias("order_date"),
        F.lit("10.00").cast("decimal(12,2)").alias("gross_revenue"),
        F.lit("3.00").cast("decimal(12,2)").alias("cogs"),
        F.lit("1.00").cast("decimal(10,2)").alias("shipping_cost"),
        F.lit("Meta Ads").alias("acquisition_channel"),
        F.lit("Completed").alias("status"),
    )
    o = staging.stage_orders(raw)
    top = dicts(customers.customer_ltv(o).orderBy(F.desc("total_lifetime_orders")).limit(1))[0]
    assert (top["customer_id"], top["total_lifetime_orders"], top["lifetime_revenue"]) == ("hot", n // 3, n // 3 * 10)
    retained = customers.cohort_retention(o).agg(F.sum("cohort_revenue").alias("s")).first().s
    assert retained == n * 10
    cycles = dicts(customers.cycle_churn(o), "subscription_cycle")
    buyers = raw.select("customer_id").distinct().count()
    assert cycles[0]["active_subscribers"] == buyers


def test_oversized_order_keeps_its_shipping(spark):
    lines = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.col("id").cast("string")).alias("order_id"),
        (F.col("id") % 50).cast("string").alias("sku"),
        F.lit("2025-01-01").cast("date").alias("line_date"),
        F.lit(1).cast("long").alias("units"),
        F.lit("2.00").cast("decimal(12,2)").alias("line_revenue"),
        F.lit("1.00").cast("decimal(12,2)").alias("line_cogs"),
        F.lit(False).alias("returned"),
    )
    orders = lines.select("order_id").distinct().withColumn("shipping_cost", F.lit("5.00").cast("decimal(10,2)"))
    total = skus.sku_margins(lines, orders).agg(F.sum("allocated_shipping").alias("s")).first().s
    assert abs(total - 5 * 2001) < 1
