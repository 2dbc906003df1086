import datetime as dt

import pytest

from marginlake.functions.calendar import moment
from marginlake.operators import customers, detect, insights, kpis, marts, staging
from marginlake.plans import bindings
from tests.helpers import ad, ads_frame, dicts, one, order, orders_frame

AS_OF = "2025-07-01 00:00:00"


def paid(i, day, revenue="100", **kw):
    return order(i, day=day, revenue=revenue, status="paid", **{"channel": "Meta", **kw})


def test_overview_by_hand(spark):
    o = orders_frame(
        spark,
        [paid(1, "2025-06-30"), paid(2, "2025-06-17"), paid(3, "2025-06-16", "50"), paid(4, "2025-07-01"), order(5, day="2025-06-30", status="refunded")],
    )
    a = ads_frame(spark, [ad("2025-06-30", "Meta", "40"), ad("2025-06-03", "Meta", "30")])
    row = one(kpis.overview(o, a, as_of=AS_OF))
    assert (row["orders"], row["revenue"], row["ad_spend"]) == (4, 350, 70)
    assert (row["roas"], row["cac"], row["aov"]) == (5.0, 17.5, 87.5)
    assert (row["gross_profit"], row["cm1"], row["cm2"]) == (210, 140, 105)
    assert row["net_margin"] == pytest.approx(30.0)
    # [06-17, 07-01): two orders; [06-03, 06-17): one order.
    assert (row["revenue_delta"], row["orders_delta"]) == (300.0, 100.0)
    assert row["spend_delta"] == pytest.approx(100 / 3)


def test_overview_of_empty_store(spark):
    row = one(kpis.overview(orders_frame(spark, []), ads_frame(spark, []), as_of=AS_OF))
    assert all(v == 0 for v in row.values())


def test_trend_leaves_out_today_and_fills_gaps(spark):
    o = orders_frame(spark, [paid(1, "2025-07-01 08:00"), paid(2, "2025-06-30 23:59"), paid(3, "2025-05-02 00:00"), paid(4, "2025-05-01 23:59")])
    rows = dicts(kpis.daily_trend(o, ads_frame(spark, [ad("2025-06-29")]), as_of="2025-07-01 12:00:00"), "date")
    assert len(rows) == 60
    assert str(rows[0]["date"]) == "2025-05-02" and str(rows[-1]["date"]) == "2025-06-30"
    assert (rows[0]["orders"], rows[-1]["orders"], rows[-2]["ad_spend"], rows[5]["revenue"]) == (1, 1, 10, 0)
    assert rows[0]["label"] == "May 2"


def test_breakdown_lists_fixed_channels(spark):
    o = orders_frame(spark, [paid(1, "2025-01-01", channel="Organic"), paid(2, "2025-01-01", channel="Meta")])
    rows = dicts(kpis.channel_breakdown(o, ads_frame(spark, [ad(channel="Meta", spend="20", impressions=1000)])), "position")
    assert [r["channel"] for r in rows] == ["Meta", "Google", "TikTok"]
    assert (rows[0]["roas"], rows[0]["cac"], rows[0]["cpm"]) == (5.0, 20.0, 20.0)
    assert (rows[1]["roas"], rows[1]["cac"], rows[1]["cpm"]) == (0.0, 0.0, 0.0)
    mix = dicts(kpis.spend_mix(kpis.channel_breakdown(o, ads_frame(spark, []))), "channel")
    assert [m["share_pct"] for m in mix] == [0.0, 0.0, 0.0]


def test_window_profit_bounds(spark):
    o = orders_frame(spark, [paid(1, "2025-06-24"), paid(2, "2025-06-23 23:59"), paid(3, "2025-05-31"), paid(4, "2025-07-01")])
    row = one(kpis.window_profit(o, ads_frame(spark, [ad("2025-06-30", spend="5")]), as_of="2025-07-01"))
    assert (row["week_profit"], row["month_profit"]) == (60, 0)
    june = one(kpis.window_profit(o, ads_frame(spark, []), as_of="2025-06-30 12:00:00"))
    assert june["month_profit"] == 130


def test_half_year_segments(spark):
    rolled = customers.customer_rollup(bindings.half_year_orders(spark, "/root/testdata/sf0.01"))
    summary = dicts(customers.segment_summary(customers.segment_customers(rolled, as_of=moment(AS_OF))), "position")
    assert {r["segment"]: r["customers"] for r in summary} == {
        "vip": 2653, "loyal": 390, "promising": 405, "new": 776, "at_risk": 1918, "lost": 1455, "active": 962,
    }
    assert [r["position"] for r in summary] == [1, 2, 3, 4, 5, 6, 7]


@pytest.mark.parametrize(
    "kpi",
    [
        lambda o, a, by: kpis.overview(o, a, as_of=AS_OF, by=by),
        lambda o, a, by: kpis.daily_trend(o, a, as_of=AS_OF, by=by),
        lambda o, a, by: kpis.channel_breakdown(o, a, by=by),
        lambda o, a, by: kpis.spend_mix(kpis.channel_breakdown(o, a, by=by), by=by),
        lambda o, a, by: kpis.window_profit(o, a, as_of="2025-06-20 12:00:00", by=by),
        lambda o, a, by: customers.customer_rollup(o, by=by),
        lambda o, a, by: customers.cohort_columns(customers.cohort_matrix(customers.customer_rollup(o, by=by), o, by=by)),
        lambda o, a, by: customers.segment_summary(customers.segment_customers(customers.customer_rollup(o, by=by), as_of=moment(AS_OF)), by=by),
        lambda o, a, by: customers.customer_kpis(customers.segment_customers(customers.customer_rollup(o, by=by), as_of=moment(AS_OF)), by=by),
        lambda o, a, by: insights.channel_insight(kpis.channel_breakdown(o, a, by=by), by=by),
        lambda o, a, by: insights.cac_insight(kpis.overview(o, a, as_of=AS_OF, by=by), by=by),
        lambda o, a, by: insights.scorecard(kpis.overview(o, a, as_of=AS_OF, by=by), by=by),
    ],
)
def test_grouped_run_equals_one_workspace(spark, sf, kpi):
    o, a = bindings.half_year_orders(spark, sf), bindings.half_year_ad_spend(spark, sf)
    alone = kpi(staging.for_workspace(o, "ws2"), staging.for_workspace(a, "ws2"), ())
    together = kpi(o, a, ("workspace_id",)).where("workspace_id = 'ws2'").drop("workspace_id")
    assert sorted(alone.columns) == sorted(together.columns)
    same = together.select(*alone.columns)
    assert sorted(map(str, alone.collect())) == sorted(map(str, same.collect()))


# -- detection -----------------------------------------------------------------


def days(spark, cacs, orders=6, profit=None):
    """Finished daily rows with the given CACs, oldest first."""
    start = dt.date(2025, 1, 1)
    rows = [(start + dt.timedelta(days=i), orders, 100.0, float(c), 1.0, profit if profit is not None else 1.0) for i, c in enumerate(cacs)]
    df = spark.createDataFrame(rows, "date date, total_orders int, total_revenue double, blended_cac double, blended_roas double, net_profit double")
    money = {c: df[c].cast("decimal(12,2)") for c in ("total_revenue", "blended_cac", "blended_roas", "net_profit")}
    return df.withColumns(money)


@pytest.mark.parametrize(
    "cacs, orders, fires",
    [
        ([10] * 7 + [12.01], 6, True),
        ([10] * 7 + [12], 6, False),
        ([10] * 7 + [13], 5, False),
        ([10] * 6 + [13], 6, True),
        ([10] * 5 + [13], 6, False),
        ([0] * 7 + [13], 6, False),
    ],
)
def test_cac_surge_boundaries(spark, cacs, orders, fires):
    daily = days(spark, cacs, orders)
    alerts = dicts(detect.scan_alerts(daily))
    assert bool(alerts) == fires
    last = dicts(detect.cac_surge(daily), "date")[-1]
    assert last["is_surge"] == fires


def test_surge_wording(spark):
    row = one(detect.scan_alerts(days(spark, [10] * 7 + [13])))
    assert (row["severity"], row["title"]) == ("CRITICAL", "Blended CAC surged +30.0% yesterday")


def test_loss_alert_only_for_latest_day(spark):
    row = one(detect.scan_alerts(days(spark, [10] * 8, profit=-1.0)))
    assert row["title"] == "Negative Net Cash Margin on 2025-01-08"
    assert detect.scan_alerts(days(spark, [10] * 6, profit=-1.0)).count() == 0
    assert detect.loss_alerts(days(spark, [10] * 6, profit=-1.0)).count() == 6


def test_z_score(spark):
    values = [10, 12, 10, 12, 10, 12, 10, 30]
    rows = dicts(detect.z_score(days(spark, values), "blended_cac"), "date")
    assert rows[6]["z_score"] is None  # six prior days only
    mean, sd = 76 / 7, (sum((v - 76 / 7) ** 2 for v in values[:7]) / 6) ** 0.5
    assert rows[7]["z_score"] == pytest.approx((30 - mean) / sd)
    assert rows[7]["is_anomaly"]
    flat = dicts(detect.z_score(days(spark, [10] * 7 + [30]), "blended_cac"), "date")[-1]
    assert flat["z_score"] is None and not flat["is_anomaly"]


def test_roas_decay(spark):
    o = staging.stage_orders(orders_frame(spark, [order(1), order(2, day="2025-01-02"), order(3, day="2025-01-03", cogs="200")]))
    a = staging.stage_ad_spend(ads_frame(spark, [ad(spend="65"), ad("2025-01-02", spend="65.01"), ad("2025-01-03")]))
    rows = dicts(detect.roas_decay(marts.channel_pnl(o, a)), "date")
    assert [r["is_below_break_even"] for r in rows] == [False, True, True]
    assert rows[2]["break_even_roas"] is None


def test_insight_texts(spark, sf):
    o, a = bindings.half_year_orders(spark, sf), bindings.half_year_ad_spend(spark, sf)
    out = insights.insights(
        kpis.channel_breakdown(o, a),
        kpis.window_profit(o, a, as_of=AS_OF),
        customers.cohort_matrix(customers.customer_rollup(o), o),
        kpis.overview(o, a, as_of=AS_OF),
    )
    rows = dicts(out, "position")
    assert [r["position"] for r in rows] == [1, 2, 3, 4]
    assert "× the ROAS of" in rows[0]["body"] and rows[1]["body"].startswith("Profit in the last 7 days: ")
    assert {r["tone"] for r in rows} <= {"positive", "negative", "neutral"}


def test_briefing_text(spark):
    o = staging.stage_orders(orders_frame(spark, [order(1, revenue="9240", cogs="2000", ship="980")]))
    a = staging.stage_ad_spend(ads_frame(spark, [ad(spend="2450")]))
    row = one(insights.morning_briefing(marts.marketing_efficiency(marts.daily_unit_economics(o, a))))
    assert row["summary"] == "Briefing: Sales: $9,240.00 | Net Profit: +$3,810.00 | MER: 3.77x"
