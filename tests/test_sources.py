import datetime as dt
import json
from decimal import Decimal

from pyspark.sql import functions as F

from marginlake import schemas
from marginlake.functions.calendar import moment
from marginlake.operators import marts, staging
from marginlake.sources import files, merge, sinks, validate
from tests.helpers import ad, ads_frame, dicts, one, order, orders_frame, plan_of

RAW = (
    "order_id string, customer_id string, order_date string, gross_revenue string, cogs string, "
    "shipping_cost string, acquisition_channel string, status string"
)


def test_good_rows_pass_and_bad_rows_are_quarantined_with_reasons(spark):
    good_row = ("1001", "c7", "2024-03-05 08:30:00", "88.20", "31.5", "4.9", "Google Ads", "Completed")
    bad_row = ("1002", "c8", "yesterday", "eighty", None, None, None, "Completed")
    raw = spark.createDataFrame([good_row, good_row, bad_row], RAW)
    source = "a feed whose name is longer than fifty characters, kept whole"
    good, dead = validate.split_orders(raw, source)
    assert one(validate.ingest_counters(validate.check_orders(raw))) == {"successful": 2, "quarantined": 1}
    assert good.count() == 2
    letter = one(dead)
    assert letter["source_system"] == source
    assert "order_date: not a timestamp: yesterday" in letter["error_reason"]
    assert "gross_revenue: not a number: eighty" in letter["error_reason"]
    assert json.loads(letter["raw_payload"])["order_id"] == "1002"
    empty = merge.upsert_orders(spark.createDataFrame([], schemas.ORDERS), good.withColumns({"seq": F.lit(1), "created_at": F.current_timestamp()}), seq=["seq"])
    assert empty.count() == 1


def test_only_full_dates_are_order_dates(spark):
    rows = [(str(i), "c", d, "1") for i, d in enumerate(("10:00:00", "2025", "2025-01", "2025-01-02", "2025-1-2 10:00:00", "2025-01-02T10:00:00Z"))]
    raw = spark.createDataFrame(rows, "order_id string, customer_id string, order_date string, gross_revenue string")
    assert sorted(r["order_id"] for r in validate.split_orders(raw, "s")[0].collect()) == ["3", "4", "5"]


def test_defaults_for_absent_and_empty_cells(spark):
    raw = spark.createDataFrame([(" 7 ", "c", "2025-01-02", "10.01")], "order_id string, customer_id string, order_date string, gross_revenue string")
    row = one(validate.good_orders(validate.check_orders(raw)))
    assert row["order_id"] == "7"
    assert row["cogs"] == Decimal("3.50")
    assert (row["shipping_cost"], row["taxes"], row["discounts"]) == (0, 0, 0)
    assert (row["acquisition_channel"], row["status"], row["landing_site"], row["currency"]) == ("Organic / Direct", "Completed", "", "USD")


def test_reasons(spark):
    cases = {
        ("1", "c", "2025-01-01", "1e3"): "",
        (None, "c", "2025-01-01", "1"): "order_id: missing",
        ("1", "", "2025-01-01", "1"): "customer_id: missing",
        ("1", "c", None, "1"): "order_date: missing",
        ("1", "c", "2025-01-01", "nan"): "gross_revenue: not a number: nan",
        ("1", "c", "2025-01-01", "99999999999"): "gross_revenue: out of range: 99999999999",
        ("x" * 101, "c", "2025-01-01", "1"): "order_id: longer than 100",
    }
    raw = spark.createDataFrame(list(cases), "order_id string, customer_id string, order_date string, gross_revenue string")
    got = [", ".join(r._reasons) for r in validate.check_orders(raw).select("_reasons").collect()]
    assert got == list(cases.values())
    good, dead = validate.split_orders(raw, "s")
    assert good.count() + dead.count() == len(cases)
    missing = validate.split_orders(raw.drop("gross_revenue"), "s")
    assert missing[0].count() == 0 and missing[1].count() == len(cases)


def _batch(spark, rows):
    frame = orders_frame(spark, [r for _, r in rows])
    return spark.createDataFrame([(s, *r) for s, r in rows], "seq int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields))


def test_upsert_keeps_first_identity_and_last_money(spark):
    target = orders_frame(spark, [order(1, "old", "2025-01-01", "100", status="Completed"), order(9, "other")])
    batch = _batch(
        spark,
        [
            (1, order(1, "new1", "2025-02-01", "200", status="Completed")),
            (2, order(1, "new2", "2025-03-01", "300", status="Refunded", channel="Google Ads")),
            (1, order(2, "first", "2025-04-01", "10")),
            (2, order(2, "second", "2025-05-01", "20")),
        ],
    )
    once = merge.upsert_orders(target, batch, seq=["seq"])
    rows = {r["order_id"]: r for r in dicts(once)}
    assert set(rows) == {"1", "2", "9"}
    assert (rows["1"]["customer_id"], rows["1"]["order_date"]) == ("old", dt.datetime(2025, 1, 1))
    assert (rows["1"]["gross_revenue"], rows["1"]["status"], rows["1"]["acquisition_channel"]) == (300, "Refunded", "Google Ads")
    assert (rows["2"]["customer_id"], rows["2"]["gross_revenue"]) == ("first", 20)
    twice = merge.upsert_orders(once, batch, seq=["seq"])
    assert dicts(twice, "order_id") == dicts(once, "order_id")


def test_upsert_takes_null_updates(spark):
    target = orders_frame(spark, [order(1, channel="Meta Ads")])
    batch = _batch(spark, [(1, order(1, channel=None))])
    assert one(merge.upsert_orders(target, batch, seq=["seq"]))["acquisition_channel"] is None


def test_ad_spend_upsert_last_wins(spark):
    target = files.ad_spend_rows(ads_frame(spark, [ad(spend="10"), ad("2025-01-02", spend="5")]))
    batch = files.ad_spend_rows(ads_frame(spark, [ad(spend="12"), ad("2025-01-03", spend="7")])).withColumn("seq", F.lit(1))
    out = merge.upsert_ad_spend(target, batch, seq=["seq"])
    assert [(r["date"].day, r["spend"]) for r in dicts(out, "date")] == [(1, 12), (2, 5), (3, 7)]
    assert {r["campaign_id"] for r in dicts(out)} == {"default_campaign"}


def test_bucketed_target_is_not_shuffled(spark):
    target = orders_frame(spark, [order(i, f"c{i}") for i in range(50)])
    sinks.save_bucketed(target, "orders_by_key", buckets=8)
    stored = spark.table("orders_by_key")
    batch = stored.limit(5).withColumn("seq", F.lit(1))
    merged = merge.upsert_orders(stored, batch, seq=["seq"])
    target_side = plan_of(merged).split("FullOuter")[1].split(":  ")
    scan = next(part for part in target_side if "Bucketed: true" in part)
    assert "Exchange" not in scan.split("FileScan")[0]
    assert merged.count() == 50
    spark.sql("drop table orders_by_key")


def test_storefront_pages(spark, tmp_path):
    page = {
        "orders": [
            {"id": 1, "customer": {"id": 7}, "total_price": "10.00", "created_at": "2025-01-01T10:00:00Z",
             "total_shipping_price_set": {"shop_money": {"amount": "4.20"}}, "source_name": "pos", "financial_status": "refunded"},
            {"id": 2, "customer": None, "created_at": "2025-01-02"},
        ]
    }
    (tmp_path / "p.json").write_text(json.dumps(page))
    (tmp_path / "q.json").write_text('{"orders": [{"id": 3, "total_price": "BAD", "created_at": "2025-01-02"}]}\n{"orders": [{"id"')
    raw = files.storefront_orders(files.read_storefront_pages(spark, str(tmp_path)))
    good, dead = validate.split_orders(raw, "storefront")
    rows = dicts(good, "order_id")
    assert len(rows) == 2
    letters = dicts(dead, "error_reason")
    assert [r["error_reason"] for r in letters] == ["gross_revenue: not a number: BAD", "malformed record"]
    assert json.loads(letters[1]["raw_payload"])["_corrupt_record"] == '{"orders": [{"id"'
    assert rows[0]["customer_id"] == "CUST_7" and rows[0]["cogs"] == Decimal("3.50")
    assert (rows[0]["shipping_cost"], rows[0]["acquisition_channel"], rows[0]["status"]) == (Decimal("4.20"), "pos", "Refunded")
    assert (rows[1]["customer_id"], rows[1]["gross_revenue"], rows[1]["shipping_cost"]) == ("CUST_GUEST", 0, 5)
    assert (rows[1]["acquisition_channel"], rows[1]["status"]) == ("Shopify Web", "Completed")


def test_insights_window(spark, tmp_path):
    days = ["2025-05-31", "2025-06-01", "2025-07-01", "2025-07-02"]
    page = {"data": [{"date_start": d, "spend": "1.50", "impressions": "10", "clicks": "2"} for d in days]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    raw = files.ad_insights(files.read_insights_pages(spark, str(tmp_path)), as_of=dt.date(2025, 7, 1))
    out, _ = validate.split_ad_spend(raw, "insights")
    assert [str(r["date"]) for r in dicts(out, "date")] == days[1:3]
    assert dicts(out)[0]["channel"] == "Meta Ads"


def test_only_recent_landings_are_read(spark, tmp_path):
    for day in ("2025-01-01", "2025-06-01"):
        folder = tmp_path / f"landed={day}"
        folder.mkdir()
        (folder / "p.json").write_text(json.dumps({"data": [{"date_start": day, "spend": "1"}]}))
    pages = files.read_insights_pages(spark, str(tmp_path), landed_since=dt.date(2025, 5, 1))
    assert pages.count() == 1
    assert "landed" in plan_of(pages).split("PartitionFilters: [")[1].split("]")[0]


def test_order_events_defaults(spark):
    events = spark.createDataFrame([(None, None, None, dt.datetime(2025, 1, 1, 0, 0, 5))], "order_id string, customer_id string, gross_revenue string, ts timestamp")
    row = one(validate.split_orders(files.order_events(events, salt="salt", arrived="ts"), "webhook")[0])
    assert row["order_id"].startswith("ORD_1735689605_")
    assert row["customer_id"].startswith("CUST_") and row["gross_revenue"] == 0


def test_ad_spend_csv(spark, tmp_path):
    path = tmp_path / "spend.csv"
    path.write_text("date,channel,spend,clicks,impressions\n2025-01-01,Meta Ads,756.99,1506,33219\n2025-01-01,TikTok Ads,202.5,560,13646\n")
    path.write_text(path.read_text() + "2025-01-02,Meta Ads,n/a,1,1\n10:30,Meta Ads,1.0,1,1\n2025-01-03,Meta Ads\n")
    good, dead = validate.split_ad_spend(files.read_ad_spend_csv(spark, str(path)), "csv")
    assert sorted(r["error_reason"].split(":")[0] for r in dicts(dead)) == ["date", "malformed record", "spend"]
    rows = dicts(good, "channel")
    assert rows[0] == {"date": dt.date(2025, 1, 1), "channel": "Meta Ads", "spend": Decimal("756.99"), "clicks": 1506, "impressions": 33219}
    assert rows[1]["spend"] == Decimal("202.50")


def test_orders_export_rename(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text('Name,Total,Buyer,Paid at,Notes\n#1,10.00,c,2025-01-01,"a, b"\n')
    raw = files.read_orders_export(spark, str(path), {"Name": "order_id", "Total": "gross_revenue", "Buyer": "customer_id", "Paid at": "order_date"})
    assert set(raw.columns) == {"order_id", "gross_revenue", "customer_id", "order_date", "_corrupt_record"}
    assert one(validate.split_orders(raw, "export")[0])["order_id"] == "#1"


def test_customer_csv_quoting(spark, tmp_path):
    c = spark.createDataFrame(
        [("c1", 'Ann "A", B', "a@x", 5, Decimal("10.00"), dt.datetime(2025, 1, 1), dt.datetime(2025, 6, 30))],
        "customer_id string, name string, email string, order_count int, total_spend decimal(12,2), first_order_at timestamp, last_order_at timestamp",
    )
    sinks.export_customers_csv(c, str(tmp_path / "out"), as_of=moment("2025-07-01"))
    parts = [p.read_text().splitlines() for p in (tmp_path / "out").glob("part-*.csv")]
    text = max(parts, key=len)
    assert text[0] == "name,email,segment,orders,ltv,first_order_at,last_order_at"
    assert text[1] == '"Ann ""A"", B",a@x,VIP,5,10.00,2025-01-01T00:00:00.000Z,2025-06-30T00:00:00.000Z'


def test_iso_text_is_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(1_735_689_600,)], "s long").select(F.timestamp_seconds("s").alias("t"))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert one(df.select(sinks.iso_text(F.col("t")).alias("x")))["x"] == "2025-01-01T00:00:00.000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_order_csv_is_sorted_across_files(spark, sf, tmp_path):
    from marginlake.plans import bindings

    sinks.export_orders_csv(bindings.half_year_orders(spark, sf), str(tmp_path / "out"))
    seen = []
    for part in sorted((tmp_path / "out").glob("part-*.csv")):
        seen += [line.rsplit(",", 1)[1] for line in part.read_text().splitlines()[1:]]
    assert len(seen) == 1500 and seen == sorted(seen)


def test_mart_folders(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "channel string, n int")
    sinks.save_mart(df, str(tmp_path / "m"), partition_by=["channel"])
    pruned = spark.read.parquet(str(tmp_path / "m")).where("channel = 'a'")
    assert "PartitionFilters: [isnotnull(channel" in plan_of(pruned)


def test_workspace_adapters(spark):
    o = spark.createDataFrame(
        [(1, 5, 9, "ORD-1", 10.1, 3.5, 5.0, "Meta", "paid", dt.datetime(2025, 1, 1))],
        "id int, user_id int, customer_id int, order_number string, revenue double, cogs double, shipping double, channel string, status string, created_at timestamp",
    )
    row = one(schemas.workspace_orders(o))
    assert row["workspace_id"] == "5" and row["gross_revenue"] == Decimal("10.10") and row["status"] == "paid"
    a = spark.createDataFrame([(1, 5, "Meta", dt.datetime(2025, 1, 1), 2.5, 10, 1, 1)], "id int, user_id int, channel string, date timestamp, spend double, impressions int, clicks int, conversions int")
    assert one(schemas.workspace_ad_spend(a))["spend"] == Decimal("2.50")


def test_surplus_cells_of_an_export_go_to_quarantine(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text("order_id,customer_id,order_date,gross_revenue\n1,a,2024-01-01,9.50\n2,b2,2024-01-01,1,234.50\n3,c,2024-01-01\n4,d,2024-01-02,100000000.00\n")
    good, dead = validate.split_orders(files.read_orders_export(spark, str(path)), "export")
    assert [(r["order_id"], float(r["gross_revenue"])) for r in dicts(good, "order_id")] == [("1", 9.5), ("4", 1e8)]
    assert [r["error_reason"] for r in dicts(dead)] == ["malformed record"] * 2
    # What validation lets in, staging and marts can hold.
    staged = staging.stage_orders(good)
    assert float(one(staged.where("order_id = '4'"))["gross_revenue"]) == 1e8
    assert marts.channel_profitability(staged).count() == 1


def test_line_breaks_in_quoted_cells(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text('order_id,customer_id,order_date,gross_revenue\n1,"Ann\nLee ""x""",2024-01-01,9.50\n2,b,2024-01-01,3\n')
    good, dead = validate.split_orders(files.read_orders_export(spark, str(path), multi_line=True), "export")
    assert [r["customer_id"] for r in dicts(good, "order_id")] == ['Ann\nLee "x"', "b"] and dead.count() == 0


def test_alerts_are_saved_once(spark, tmp_path):
    path = str(tmp_path / "alerts")
    alerts = lambda *days: spark.createDataFrame([(dt.date(2025, 1, d), "CRITICAL", f"t{d}", "do") for d in days], "date date, severity string, title string, action string")
    for batch, days in ((0, (1, 2, 2)), (0, (1, 2)), (1, (2, 3)), (1, (2, 3)), (2, (1, 3))):
        sinks.save_alerts(alerts(*days), path, batch)
    assert sorted((r["title"], r["batch"]) for r in dicts(sinks.read_alerts(spark, path))) == [("t1", 0), ("t2", 0), ("t3", 1)]


def test_days_of_a_stored_mart_are_refreshed(spark, tmp_path):
    path = str(tmp_path / "mart")
    mart = lambda **days: spark.createDataFrame([(dt.date(2025, 1, int(d[1:])), v) for d, v in days.items()], "date date, total int")
    sinks.save_mart(mart(d1=1, d2=2, d3=3), path, partition_by=["date"])
    before = {f: (tmp_path / "mart" / f).stat().st_mtime_ns for f in ("date=2025-01-01",)}
    # The second day has another value, the third none any more, the fourth is new.
    sinks.refresh_days(mart(d2=20, d4=4), mart(d2=0, d3=0, d4=0).select("date"), path)
    assert [(r["date"].day, r["total"]) for r in dicts(spark.read.parquet(path), "date")] == [(1, 1), (2, 20), (4, 4)]
    assert before == {f: (tmp_path / "mart" / f).stat().st_mtime_ns for f in before}


def test_counters_come_with_the_write(spark, tmp_path):
    raw = spark.createDataFrame([("1", "c", "2025-01-01", "5"), ("2", "c", "2025-01-01", "x"), ("2", "c", "2025-01-01", "7")], "order_id string, customer_id string, order_date string, gross_revenue string")
    counts = sinks.save_checked(validate.check_orders(raw), str(tmp_path / "out"), "feed")
    assert counts == {"successful": 2, "quarantined": 1}
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.where("good = 'true'").count() == 2 and one(stored.where("good = 'false'"))["error_reason"] == "gross_revenue: not a number: x"
    assert sinks.save_checked(validate.check_orders(raw.limit(0)), str(tmp_path / "none"), "feed") == {"successful": 0, "quarantined": 0}
