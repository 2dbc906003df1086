import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marginlake.operators import marts, staging
from marginlake.schemas import ORDER_EVENT
from marginlake.sources import buckets, files
from marginlake.streaming import billing, changelog, ingest, live, throttle
from tests.helpers import ad, ads_frame, dicts, one, order, orders_frame, plan_of

FEED = "order_id string, customer_id string, order_date string, gross_revenue string, status string, _seq long"


def drop_file(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def feed_row(i, revenue="10", customer="c", day="2025-01-01", status="Completed", seq=0):
    return {"order_id": str(i), "customer_id": customer, "order_date": day, "gross_revenue": revenue, "status": status, "_seq": seq}


def run_ingest(spark, tmp_path):
    stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    ingest.ingest_orders(stream, str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()


def test_ingest_over_batches_with_corrections(spark, tmp_path):
    root = str(tmp_path / "store")
    drop_file(tmp_path / "in", "a.json", [feed_row(1, customer="first"), feed_row(2), feed_row(3, "BAD")])
    run_ingest(spark, tmp_path)
    assert changelog.current_orders(spark, root).count() == 2
    drop_file(
        tmp_path / "in",
        "b.json",
        [feed_row(1, "30", "second", "2025-02-02", "Refunded", 2), feed_row(1, "20", "third", seq=1), feed_row(4)],
    )
    run_ingest(spark, tmp_path)
    rows = {r["order_id"]: r for r in dicts(changelog.current_orders(spark, root))}
    assert set(rows) == {"1", "2", "4"}
    assert (rows["1"]["gross_revenue"], rows["1"]["status"], rows["1"]["customer_id"]) == (30, "Refunded", "first")
    # The live feed corrects money and status only: cost keeps its first value.
    assert rows["1"]["cogs"] == Decimal("3.50")
    assert one(changelog.dead_letters(spark, root))["error_reason"] == "gross_revenue: not a number: BAD"

    before = dicts(changelog.current_orders(spark, root), "order_id")
    assert changelog.compact(spark, root) == 1
    assert changelog.compact(spark, root) == 1  # nothing new to fold
    assert dicts(changelog.current_orders(spark, root), "order_id") == before
    drop_file(tmp_path / "in", "c.json", [feed_row(2, "77"), feed_row(5)])
    run_ingest(spark, tmp_path)
    after = {r["order_id"]: r["gross_revenue"] for r in dicts(changelog.current_orders(spark, root))}
    assert after == {"1": 30, "2": 77, "4": 10, "5": 10}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    raw = spark.createDataFrame([tuple(feed_row(i, seq=i).values()) for i in range(3)], FEED)
    for _ in range(2):
        changelog.write_batch(raw, 0, root, "feed")
    assert changelog.current_orders(spark, root).count() == 3
    assert changelog.current_orders(spark, str(tmp_path / "nothing")).count() == 0
    assert changelog.dead_letters(spark, str(tmp_path / "nothing")).count() == 0


def test_webhook_events_through_the_same_ingest(spark, tmp_path):
    drop_file(tmp_path / "in", "a.json", [{"order_id": "9", "customer_id": "42", "gross_revenue": "10.00"}])
    events = spark.readStream.schema(ORDER_EVENT).json(str(tmp_path / "in"))
    feed = files.order_events(events, salt="salt").withColumn("_seq", F.unix_micros("order_date"))
    ingest.ingest_orders(feed, str(tmp_path / "s"), str(tmp_path / "ck")).awaitTermination()
    row = one(changelog.current_orders(spark, str(tmp_path / "s")))
    assert row["customer_id"] == "CUST_b0c8fbfacd557d94" and row["shipping_cost"] == 5


def live_run(spark, tmp_path, order_files, ad_files, delay):
    for i, df in enumerate(order_files):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "orders"))
    for df in ad_files:
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "ads"))
    o = spark.readStream.schema(order_files[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "orders"))
    a = spark.readStream.schema(ad_files[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ads"))
    out = str(tmp_path / "out")
    live.save_updates(live.daily_flows(o, a, delay=delay), out, str(tmp_path / "ck")).awaitTermination()
    updates = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return live.economics_of(live.latest_days(updates))


def test_live_days_equal_batch(spark, tmp_path):
    first = orders_frame(spark, [order(1), order(2, day="2025-01-02"), order(3, day="2025-01-02", status="Refunded")])
    second = orders_frame(spark, [order(1), order(4), order(5, day="2025-01-03")])  # order 1 again
    ads = [ads_frame(spark, [ad(), ad("2025-01-02")]), ads_frame(spark, [ad("2025-01-05", spend="3")])]
    got = dicts(live_run(spark, tmp_path, [first, second], ads, "30 days"), "date")
    o = staging.stage_orders(first.union(second).dropDuplicates(["order_id"]))
    a = staging.stage_ad_spend(ads[0].union(ads[1]))
    want = dicts(marts.daily_unit_economics(o, a), "date")
    assert [{k: str(v) for k, v in r.items()} for r in got] == [{k: str(v) for k, v in r.items()} for r in want]


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    now = [orders_frame(spark, [order(1, day="2025-03-01")]), orders_frame(spark, [order(2, day="2025-03-02")])]
    late = orders_frame(spark, [order(3, day="2025-01-01")])
    ads = [ads_frame(spark, [ad("2025-03-01")]), ads_frame(spark, [ad("2025-03-02")]), ads_frame(spark, [ad("2025-03-02")])]
    days = [str(r["date"]) for r in dicts(live_run(spark, tmp_path, [*now, late], ads, "2 days"), "date")]
    assert "2025-01-01" not in days and "2025-03-02" in days


def land(spark, root, batch, rows):
    raw = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], FEED)
    changelog.write_batch(raw, batch, root, "t")


def test_sums_follow_corrections_and_late_orders(spark, tmp_path):
    root = str(tmp_path / "s")
    ads = ads_frame(spark, [ad(spend="10"), ad("2025-01-09", spend="4")])
    by_day = lambda: {str(r["date"]): (r["total_orders"], float(r["total_revenue"]), float(r["net_profit"])) for r in dicts(live.corrected_days(spark, root, ads))}
    land(spark, root, 0, [("1", "c", "2025-01-01", "100", "Completed"), ("2", "c", "2025-01-02", "50", "Completed"), ("3", "c", "2025-01-02", "20", "Pending")])
    assert by_day() == {"2025-01-01": (1, 100.0, 55.0), "2025-01-02": (1, 50.0, 32.5), "2025-01-09": (0, 0.0, -4.0)}
    # A refund, a new price, an order that is completed at last, one that is months late, and one that changes nothing.
    land(spark, root, 1, [("1", "c", "2025-01-01", "100", "Refunded"), ("3", "c", "2025-01-02", "30", "Completed"), ("4", "c", "2024-06-01", "10", "Completed"), ("2", "x", "2025-05-05", "50", "Completed")])
    assert changelog.deltas(spark, root).count() == 5
    want = {"2024-06-01": (1, 10.0, 6.5), "2025-01-01": (0, 0.0, -10.0), "2025-01-02": (2, 80.0, 55.5), "2025-01-09": (0, 0.0, -4.0)}
    assert by_day() == want
    assert by_day() == want and changelog.deltas(spark, root).count() == 0  # no delta counts twice
    land(spark, root, 1, [("9", "c", "2025-01-01", "100", "Completed")])  # a replay
    assert by_day() == want


def test_compaction_writes_the_log_not_the_store(spark, tmp_path):
    """Rows written by merges stay below those landed times the levels; folded folders go."""
    root = str(tmp_path / "s")
    runs = lambda: buckets.latest_list(spark, root)[1]["runs"]
    written, seen, want = 0, set(), {}
    for k in range(17):
        rows = [(str(i), f"c{k}", "2025-01-01", str(k + 1), "Completed") for i in range(k * 3, k * 3 + 6)]
        land(spark, root, k, rows)
        for i, who, *_ in rows:
            want[i] = (want.get(i, (who,))[0], k + 1)
        assert changelog.compact(spark, root) == k
        for run in runs():
            if run["level"] and run["folder"] not in seen:
                written += spark.read.parquet(run["folder"]).count()
            seen.add(run["folder"])
        assert {r["order_id"]: (r["customer_id"], int(r["gross_revenue"])) for r in dicts(changelog.current_orders(spark, root))} == want
    assert sorted(run["level"] for run in runs()) == [0, 2] and written <= 2 * 17 * 6
    live_now = {run["folder"].rsplit("/", 1)[1] for run in runs()}
    there = set(buckets.names_in(spark, f"{root}/runs"))
    assert live_now <= there and len(there) <= len(live_now) + 4  # what the last commit replaced goes with the next
    assert len(buckets.names_in(spark, f"{root}/lists")) <= 4
    assert "Exchange" not in plan_of(changelog.current_orders(spark, root))


def event(kind, user=None, customer=None, seq=0, **extra):
    obj = {"id": f"cs_{seq}", "customer": customer, **extra}
    if user is not None:
        obj["metadata"] = {"userId": str(user), **({"plan": extra["plan"]} if "plan" in extra else {})}
    return (seq, dt.datetime(2025, 1, 1, 0, seq), json.dumps({"type": kind, "data": {"object": obj}}))


BILLING = [
    event("checkout.session.completed", 1, "cus_1", 1),
    event("customer.subscription.deleted", None, "cus_1", 2),
    event("checkout.session.completed", 2, "cus_2", 3, plan="enterprise", amount_total=9900, currency="eur"),
    event("customer.subscription.deleted", None, "cus_unknown", 4),
    event("invoice.paid", 2, "cus_2", 5),
    event("checkout.session.completed", 0, "cus_3", 6),
    event("checkout.session.completed", 3, None, 7),
    event("customer.subscription.deleted", None, "cus_4", 8),
    event("checkout.session.completed", 4, "cus_4", 9),
    event("checkout.session.completed", 5, "cus_5", 10),
    event("customer.subscription.deleted", None, "cus_5", 11),
    event("checkout.session.completed", 5, "cus_5", 12, plan="enterprise"),
]


def test_touched_days_come_from_the_log(spark, tmp_path):
    root = str(tmp_path / "s")

    land(spark, root, 0, [("1", "c", "2025-01-01", "10", "Completed"), ("2", "c", "2025-01-02", "10", "Completed")])
    changelog.compact(spark, root)
    land(spark, root, 1, [("1", "c", "2025-03-09", "10", "Refunded"), ("3", "c", "2025-01-05", "10", "Completed")])
    days = [str(r["date"]) for r in dicts(changelog.touched_days(spark, root, after=0), "date")]
    assert days == ["2025-01-01", "2025-01-05"]
    assert changelog.touched_days(spark, root, after=1).count() == 0


def test_billing_fold(spark):
    landed = spark.createDataFrame(BILLING, "seq long, received_at timestamp, body string")
    events = billing.parse_events(landed)
    plans = {r["user_id"]: r["plan"] for r in dicts(billing.current_plans(events))}
    assert plans == {1: "trial", 2: "enterprise", 3: "pro", 4: "pro", 5: "enterprise"}
    paid = {r["provider_id"]: r for r in dicts(billing.payments(events))}
    assert set(paid) == {"cs_1", "cs_3", "cs_7", "cs_9", "cs_10", "cs_12"}
    assert (paid["cs_1"]["amount"], paid["cs_1"]["currency"], paid["cs_1"]["status"]) == (499, "usd", "paid")
    assert (paid["cs_3"]["amount"], paid["cs_3"]["currency"]) == (99, "eur")


def test_cancellation_hits_the_user_who_still_has_the_customer(spark):
    rows = [
        event("checkout.session.completed", 1, "cus_a", 1),
        event("checkout.session.completed", 1, "cus_b", 2),
        event("customer.subscription.deleted", None, "cus_a", 3),  # user 1 has cus_b by now
        event("checkout.session.completed", 2, "cus_c", 4),
        event("checkout.session.completed", 3, "cus_c", 5),
        event("customer.subscription.deleted", None, "cus_c", 6),  # user 3 named it last
    ]
    events = billing.parse_events(spark.createDataFrame(rows, "seq long, received_at timestamp, body string"))
    plans = {r["user_id"]: r["plan"] for r in dicts(billing.current_plans(events))}
    assert plans == {1: "pro", 2: "pro", 3: "trial"}
    log = [(r["user_id"], r["action"]) for r in dicts(billing.activity(events), "at")]
    assert log == [(1, "billing.upgrade"), (1, "billing.upgrade"), (2, "billing.upgrade"), (3, "billing.upgrade"), (3, "billing.canceled")]


def test_order_counts_once_it_is_completed(spark, tmp_path):
    """Pending in one batch, completed in the next, completed again in the third."""
    schema = "order_id string, order_date timestamp, gross_revenue decimal(12,2), cogs decimal(12,2), shipping_cost decimal(10,2), status string"
    day = dt.datetime(2025, 1, 1)
    for k, status in enumerate(("Pending", "Completed", "Completed")):
        row = ("1", day, Decimal("10.00"), Decimal("3.00"), Decimal("1.00"), status)
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
        ads = spark.createDataFrame([(day, Decimal("1.00"))], "date timestamp, spend decimal(12,2)")
        if k == 0:
            ads.coalesce(1).write.parquet(str(tmp_path / "a"))
        o = spark.readStream.schema(schema).parquet(str(tmp_path / "o"))
        a = spark.readStream.schema(ads.schema).parquet(str(tmp_path / "a"))
        live.save_updates(live.daily_flows(o, a), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    updates = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out/batch=*"))
    assert [(r["n"], r["revenue"], r["spend"]) for r in dicts(live.latest_days(updates))] == [(1, Decimal("10.00"), Decimal("1.00"))]


def test_billing_stream_equals_batch(spark, tmp_path):
    landed = spark.createDataFrame(BILLING, "seq long, received_at timestamp, body string")
    landed.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    billing.land_events(billing.parse_events(stream), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    live_log = spark.read.parquet(str(tmp_path / "log"))
    want = dicts(billing.current_plans(billing.parse_events(landed)), "user_id")
    assert dicts(billing.current_plans(live_log), "user_id") == want


def brute_force_windows(events, window, limit):
    """The rule event by event."""
    out, ends = {}, {}
    for key, t in sorted(events, key=lambda e: e[1]):
        if key not in ends or ends[key] < t:
            ends[key] = t + dt.timedelta(seconds=window)
            out[key, t] = 0
            start = t
        else:
            start = ends[key] - dt.timedelta(seconds=window)
        out[key, start] += 1
    return sorted((k, s, n, min(n, limit), max(n - limit, 0)) for (k, s), n in out.items())


@pytest.mark.parametrize("window", [1, 60, 600])
def test_throttle_equals_brute_force(spark, tmp_path, window):
    rng = random.Random(5)
    base = dt.datetime(2025, 1, 1)
    events = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", base + dt.timedelta(seconds=rng.randrange(4000))) for _ in range(300)]
    events += [("edge", base), ("edge", base + dt.timedelta(seconds=600)), ("edge", base + dt.timedelta(seconds=601))]
    df = spark.createDataFrame(events, "who string, ts timestamp")
    events += [("ties", base + dt.timedelta(seconds=s)) for s in (5, 5, 5, 5, 5, 5)]
    df = spark.createDataFrame(events, "who string, ts timestamp")
    got = throttle.audit(df, str(tmp_path / "t"), key="who", at="ts", limit=4, window=window)
    rows = sorted((r["key"], r["window_start"], r["events"], r["allowed"], r["rejected"]) for r in dicts(got))
    assert rows == brute_force_windows(events, window, 4)


def test_throttle_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "who string, ts timestamp")
    assert throttle.audit(df, str(tmp_path / "t"), key="who", at="ts", limit=4, window=600).count() == 0


def test_deltas_and_merges_do_not_sort_what_lies_sorted(spark, tmp_path):
    root = str(tmp_path / "s")
    for k in range(3):
        land(spark, root, k, [(str(i), "c", "2025-01-01", str(k + 1), "Completed") for i in range(k, k + 40)])
    content = buckets.latest_list(spark, root)[1]
    plans = [plan_of(changelog._deltas(spark, content | {"runs": content["runs"][:2]}, content["runs"][2]))]
    plans.append(plan_of(changelog._merged(spark, content, content["runs"][:2])))
    for plan in plans:
        assert "SortMergeJoin" in plan
        assert not any(step in plan for step in ("Exchange", "Sort [", "SortAggregate"))


def test_no_batch_is_cached(spark, tmp_path, monkeypatch):
    """Neither whole batches nor payloads of good rows are held in memory."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "persist", lambda *_: pytest.fail("a batch was cached"))
    land(spark, str(tmp_path / "s"), 0, [("1", "c", "2025-01-01", "10", "Completed"), ("2", "c", "2025-01-01", "ten", "Completed")])
    assert changelog.current_orders(spark, str(tmp_path / "s")).count() == 1
    assert json.loads(one(changelog.dead_letters(spark, str(tmp_path / "s")))["raw_payload"])["gross_revenue"] == "ten"


def test_deltas_of_many_runs(spark, tmp_path, monkeypatch):
    """More runs than deltas join one by one, never merged: prices, first customers and sums as if by hand."""
    monkeypatch.setattr(changelog, "JOINED", 3)
    root, rng, want, sums = str(tmp_path / "s"), random.Random(4), {}, {}
    for k in range(6):
        chosen = rng.sample(range(12), 5)
        land(spark, root, k, [(str(i), f"c{k}", f"2025-01-0{k + 1}", str(rng.randrange(3)), "Completed") for i in chosen])
        held = {r["order_id"]: r for r in dicts(changelog.current_orders(spark, root))}
        for r in dicts(changelog.deltas(spark, root, after=k - 1)):
            sums[r["order_id"], r["order_date"]] = sums.get((r["order_id"], r["order_date"]), 0) + r["sign"] * r["gross_revenue"]
        for i in map(str, chosen):
            want[i] = (want.get(i, (f"c{k}",))[0], held[i]["gross_revenue"])
        assert {i: (r["customer_id"], r["gross_revenue"]) for i, r in held.items()} == want
        assert {i: v for (i, _), v in sums.items()} == {i: r["gross_revenue"] for i, r in held.items()}
        assert set(sums) == {(i, r["order_date"]) for i, r in held.items()}
