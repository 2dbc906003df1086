from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marginlake.operators import customers, logs, marts, skus, staging
from marginlake.plans import bindings, warehouse
from tests.helpers import ad, ads_frame, dicts, one, order, orders_frame


def staged(spark, orders, ads=()):
    return (
        staging.stage_orders(orders_frame(spark, orders)),
        staging.stage_ad_spend(ads_frame(spark, list(ads))),
    )


def test_daily_outer_join_and_ratios(spark):
    o, a = staged(
        spark,
        [order(1), order(2), order(3, status="Refunded"), order(4, day="2025-01-03")],
        [ad(spend="50"), ad("2025-01-02", spend="7")],
    )
    days = dicts(marts.daily_unit_economics(o, a), "date")
    assert [d["total_orders"] for d in days] == [2, 0, 1]
    assert days[0]["net_profit"] == 2 * 65 - 50 and days[0]["blended_cac"] == 25 and days[0]["blended_roas"] == 4
    assert days[1]["net_profit"] == -7 and days[1]["blended_cac"] == 0 and days[1]["blended_roas"] == 0
    assert days[2]["total_ad_spend"] == 0 and days[2]["blended_roas"] == 0


def test_duplicate_ids_count_once_unless_declared_unique(spark):
    o, a = staged(spark, [order(1), order(1)])
    assert one(marts.daily_unit_economics(o, a))["total_orders"] == 1
    assert one(marts.daily_unit_economics(o, a, unique_ids=True))["total_orders"] == 2
    assert one(marts.sales_velocity(o))["total_units_sold"] == 1


def test_channel_pnl_organic_and_ads_only(spark):
    o, a = staged(spark, [order(1, channel=None)], [ad(channel="TikTok Ads")])
    rows = dicts(marts.channel_pnl(o, a), "channel")
    assert [r["channel"] for r in rows] == ["Organic / Direct", "TikTok Ads"]
    assert (rows[1]["channel_roas"], rows[1]["channel_cac"], rows[1]["channel_net_profit"]) == (0, 0, -10)


def test_profitability_counts_every_status(spark):
    o, _ = staged(spark, [order(1), order(2, status="Refunded"), order(3, status="Pending"), order(4, status=None)])
    row = one(marts.channel_profitability(o))
    assert (row["total_orders_placed"], row["completed_orders"], row["refunded_orders"]) == (4, 1, 1)
    assert row["refund_rate_pct"] == 25 and row["total_net_profit"] == 65 - 3 * 35


def test_share_of_zero_revenue_is_null(spark):
    o, _ = staged(spark, [order(1, revenue="0")])
    assert one(marts.attribution_share(o))["revenue_share_pct"] is None


def test_macro_summary_of_nothing(spark):
    o, a = staged(spark, [order(1, revenue="0")], [ad()])
    mer = marts.marketing_efficiency(marts.daily_unit_economics(o, a))
    row = one(marts.macro_summary(mer))
    assert all(v == 0 for v in row.values())


def test_invariants(spark, sf):
    o = staging.stage_orders(bindings.store_orders(spark, sf))
    a = staging.stage_ad_spend(bindings.store_ad_spend(spark, sf))
    daily, pnl = marts.daily_unit_economics(o, a), marts.channel_pnl(o, a)
    revenue = staging.completed_only(o).agg(F.sum("gross_revenue").alias("s")).first().s
    assert daily.agg(F.sum("total_revenue").alias("s")).first().s == revenue
    assert pnl.agg(F.sum("attributed_revenue").alias("s")).first().s == revenue
    assert daily.agg(F.sum("net_profit").alias("s")).first().s == pnl.agg(F.sum("channel_net_profit").alias("s")).first().s
    total = daily.agg(*[F.sum(c).alias(c) for c in ("total_orders", "total_ad_spend", "net_profit")]).first()
    assert tuple(total) == (1007, Decimal("16093917.49"), Decimal("147657938.31"))
    shares = marts.attribution_share(o).agg(F.sum("revenue_share_pct").alias("s")).first().s
    assert abs(shares - 100) <= Decimal("0.05")
    start = customers.cohort_retention(o).where("month_number = 0")
    assert start.where("retention_rate_pct <> 100").count() == 0


def test_cohorts_skip_months_and_nameless_customers(spark):
    o, _ = staged(
        spark,
        [order(1, "a", "2024-11-30"), order(2, "a", "2025-02-01"), order(3, "b", "2024-11-01"), order(4, None, "2024-11-01"),
         order(5, "c", "2024-11-02", status="Refunded"), order(6, "c", "2024-12-01")],
    )
    rows = dicts(customers.cohort_retention(o), "cohort_month", "month_number")
    assert [(str(r["cohort_month"]), r["month_number"], r["active_customers"], r["retention_rate_pct"]) for r in rows] == [
        ("2024-11-01", 0, 2, 100), ("2024-11-01", 3, 1, 50), ("2024-12-01", 0, 1, 100),
    ]


def test_cycles_stop_at_six(spark):
    o, _ = staged(spark, [order(i, "a", f"2025-01-{i:02d}") for i in range(1, 9)] + [order(20, "b")])
    rows = dicts(customers.cycle_churn(o), "subscription_cycle")
    assert [r["active_subscribers"] for r in rows] == [2, 1, 1, 1, 1, 1]
    assert rows[0]["cycle_churn_rate_pct"] is None
    assert rows[1]["cycle_churn_rate_pct"] == 50 and rows[2]["cycle_churn_rate_pct"] == 0
    assert rows[1]["cycle_retention_pct"] == 50


def test_repurchase_windows(spark):
    o, _ = staged(
        spark,
        [order(1, "a", "2025-01-01"), order(2, "a", "2025-01-31"), order(3, "b", "2025-01-01"), order(4, "b", "2025-02-01"), order(5, "c", "2025-01-09")],
    )
    row = one(customers.repurchase_windows(o))
    assert (row["customers"], row["repurchased_30d"], row["repurchased_60d"], row["repurchased_90d"]) == (3, 1, 2, 2)


def test_cohort_definitions_differ_on_refunded_first_order(spark):
    raw = orders_frame(spark, [order(1, "a", "2025-01-05", status="refunded"), order(2, "a", "2025-02-05", status="paid")])
    matrix = customers.cohort_columns(customers.cohort_matrix(customers.customer_rollup(raw), raw))
    row = one(matrix)
    assert (row["label"], row["size"], row["m0"], row["m1"], row["m2"]) == ("Jan 25", 1, 0.0, 100.0, 0.0)
    kept = one(customers.cohort_retention(staging.stage_orders(raw, completed="paid"), completed="paid"))
    assert str(kept["cohort_month"]) == "2025-02-01"


def test_no_returning_cohort_gives_no_row(spark):
    raw = orders_frame(spark, [order(1, "a", "2025-01-05", status="paid")])
    matrix = customers.cohort_matrix(customers.customer_rollup(raw), raw)
    assert customers.latest_returning_cohort(matrix).count() == 0


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 1)], "k string, t int")
    assert [(r["k"], r["t"]) for r in dicts(logs.latest_per_key(df, "k", "t", 3), "k", "t")] == [("a", 7), ("a", 8), ("a", 9), ("b", 1)]


def test_views_answer_sql(spark, sf):
    names = warehouse.register_views(bindings.store_orders(spark, sf), bindings.store_ad_spend(spark, sf))
    assert len(names) == 11
    for name in names:
        assert spark.sql(f"select count(*) as n from {name}").first().n > 0
    top = spark.sql(
        "select date, total_orders, blended_cac from fct_daily_unit_economics where total_revenue > 0 order by date desc limit 30"
    )
    assert top.count() == 30


def test_presented_order(spark, sf):
    o = staging.stage_orders(bindings.store_orders(spark, sf))
    rows = dicts(warehouse.presented("dim_customer_ltv", customers.customer_ltv(o)))
    assert [r["lifetime_revenue"] for r in rows] == sorted((r["lifetime_revenue"] for r in rows), reverse=True)


LINES = "order_id string, sku string, line_date date, units long, line_revenue decimal(12,2), line_cogs decimal(12,2), returned boolean"


def test_sku_margin_splits_shipping_by_revenue(spark):
    import datetime as dt

    day = dt.date(2025, 1, 1)
    lines = spark.createDataFrame(
        [("1", "x", day, 1, Decimal("75"), Decimal("10"), False), ("1", "y", day, 1, Decimal("25"), Decimal("10"), True), ("2", "x", day, 3, Decimal("0"), Decimal("0"), False)],
        LINES,
    )
    orders = orders_frame(spark, [order(1, ship="8"), order(2, ship="4")])
    x, y = dicts(skus.sku_margins(lines, orders), "sku")
    assert (x["allocated_shipping"], y["allocated_shipping"]) == (6, 2)
    assert (x["order_lines"], x["units_sold"], y["return_rate_pct"]) == (2, 4, 100)
    assert y["net_profit"] == 25 - 25 - 10 - 2


def test_runway(spark):
    import datetime as dt

    lines = spark.createDataFrame(
        [("1", "x", dt.date(2025, 6, 30), 60, Decimal("1"), Decimal("1"), False), ("2", "x", dt.date(2025, 7, 1), 99, Decimal("1"), Decimal("1"), False)], LINES
    )
    stock = spark.createDataFrame([("x", 100), ("idle", 5)], "sku string, on_hand long")
    idle, x = dicts(skus.stock_runway(lines, stock, as_of="2025-07-01", days=30), "sku")
    assert (x["daily_velocity"], x["days_left"]) == (2, 50)
    assert idle["days_left"] is None and idle["daily_velocity"] == 0


BY = ("workspace_id",)


@pytest.mark.parametrize(
    "mart",
    [
        lambda o, a, by: marts.daily_unit_economics(o, a, by=by),
        lambda o, a, by: marts.channel_pnl(o, a, by=by),
        lambda o, a, by: marts.channel_profitability(o, by=by),
        lambda o, a, by: marts.attribution_share(o, by=by),
        lambda o, a, by: marts.sales_velocity(o, by=by),
        lambda o, a, by: marts.sales_velocity(o, by=by, unique_ids=True),
        lambda o, a, by: customers.customer_ltv(o, by=by),
        lambda o, a, by: customers.tier_revenue_share(customers.customer_ltv(o, by=by), by=by),
        lambda o, a, by: customers.cohort_retention(o, by=by),
        lambda o, a, by: customers.cycle_churn(o, by=by),
        lambda o, a, by: customers.repurchase_windows(o, by=by),
        lambda o, a, by: marts.macro_summary(marts.marketing_efficiency(marts.daily_unit_economics(o, a, by=by), by=by), by=by),
        lambda o, a, by: marts.channel_rollup(marts.channel_pnl(o, a, by=by), by=by),
    ],
)
def test_grouped_run_equals_one_workspace(spark, sf, mart):
    """All tenants in one job give each tenant what it would get alone."""
    o = staging.stage_orders(bindings.store_orders(spark, sf), by=BY)
    a = staging.stage_ad_spend(bindings.store_ad_spend(spark, sf), by=BY)
    alone = mart(staging.for_workspace(o, "ws1"), staging.for_workspace(a, "ws1"), ())
    together = mart(o, a, BY).where("workspace_id = 'ws1'").drop("workspace_id")
    assert alone.columns == together.columns
    assert sorted(map(str, alone.collect())) == sorted(map(str, together.collect()))
