import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marginlake.sources import buckets, merge, store
from tests.helpers import dicts, order, orders_frame, plan_of


def live_files(spark, root):
    _, content = buckets.latest_list(spark, root)
    return {int(k): sorted(f for f in os.listdir(path) if f.endswith(".parquet")) for k, path in content["folders"].items()}


def numbered_orders(spark, n, **changes):
    return orders_frame(spark, [order(i, **changes) for i in range(n)])


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path / "store")
    store.create(numbered_orders(spark, 200), root, key=["order_id"], buckets=16)
    before = live_files(spark, root)
    assert len(before) == 16 and all(len(f) == 1 for f in before.values())
    batch = orders_frame(spark, [order(7, customer="new", revenue="55", status="Refunded"), order(7, revenue="54"), order(900)])
    batch = batch.withColumn("seq", F.when(F.col("gross_revenue") == 55, 2).otherwise(1))
    touched = store.merge_orders(batch, root, 0, seq=["seq"])
    assert 1 <= len(touched) <= 2
    after = live_files(spark, root)
    assert {k for k in after if after[k] != before.get(k)} == set(touched)
    rows = {r["order_id"]: r for r in dicts(store.read(spark, root))}
    assert len(rows) == 201
    assert (rows["7"]["gross_revenue"], rows["7"]["status"], rows["7"]["customer_id"]) == (55, "Refunded", "c1")
    assert rows["8"]["gross_revenue"] == 100 and rows["900"]["gross_revenue"] == 100


def test_replay_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    store.create(numbered_orders(spark, 20), root, key=["order_id"], buckets=4)
    batch = numbered_orders(spark, 5, revenue="9").withColumn("seq", F.lit(1))
    store.merge_orders(batch, root, 3, seq=["seq"])
    before = live_files(spark, root), buckets.latest_list(spark, root)
    assert store.merge_orders(batch, root, 3, seq=["seq"]) == []
    assert store.merge_orders(numbered_orders(spark, 5, revenue="1").withColumn("seq", F.lit(1)), root, 2, seq=["seq"]) == []
    assert (live_files(spark, root), buckets.latest_list(spark, root)) == before


def test_stored_rows_are_not_shuffled(spark, tmp_path):
    root = str(tmp_path / "store")
    store.create(numbered_orders(spark, 50), root, key=["order_id"], buckets=4)
    held = store.read(spark, root)
    batch = numbered_orders(spark, 9).withColumn("seq", F.lit(1))
    columns = [c for c in held.columns if c != "order_id"]
    plan = plan_of(merge.upsert(held, batch, key=["order_id"], immutable=columns[:2], mutable=columns[2:], seq=["seq"], buckets=4))
    stored, moved = plan.split("SortMergeJoin")[1].split("FileScan parquet", 1)
    assert "Exchange" not in stored and "Bucketed: true" in moved and "Exchange hashpartitioning(order_id" in moved
    assert "Exchange" not in plan_of(held.groupBy("order_id").count())


def test_equals_merge_in_memory(spark, tmp_path):
    root = str(tmp_path / "store")
    first = numbered_orders(spark, 30)
    store.create(first, root, key=["order_id"], buckets=8)
    want = first
    for k in range(3):
        rows = [order(i, customer=f"c{k}", revenue=str(10 * k + i), status="Refunded" if i % 2 else "Completed") for i in range(k, 60, k + 2)]
        batch = orders_frame(spark, rows).withColumn("seq", F.lit(k))
        store.merge_orders(batch, root, k, seq=["seq"])
        want = merge.upsert_orders(want, batch, seq=["seq"])
    assert dicts(store.read(spark, root), "order_id") == dicts(want, "order_id")


def test_key_of_several_columns(spark, tmp_path):
    root = str(tmp_path / "ads")
    schema = "date date, channel string, campaign_id string, spend decimal(12,2)"
    day = dt.date(2025, 1, 1)
    store.create(spark.createDataFrame([(day, "Meta", "a", Decimal(1)), (day, "Meta", "b", Decimal(2))], schema), root, key=["date", "channel", "campaign_id"], buckets=4)
    batch = spark.createDataFrame([(day, "Meta", "b", Decimal(5), 1), (day, "TikTok", "a", Decimal(7), 1)], schema + ", seq int")
    store.merge_ad_spend(batch, root, 0, seq=["seq"])
    got = [(r["channel"], r["campaign_id"], int(r["spend"])) for r in dicts(store.read(spark, root), "channel", "campaign_id")]
    assert got == [("Meta", "a", 1), ("Meta", "b", 5), ("TikTok", "a", 7)]


def test_second_writer_of_a_version_fails(spark, tmp_path):
    root = str(tmp_path / "lists")
    buckets.commit_list(spark, root, 0, {"who": "first"})
    with pytest.raises(FileExistsError):
        buckets.commit_list(spark, root, 0, {"who": "second"})
    assert buckets.latest_list(spark, root) == (0, {"who": "first"})
    assert buckets.latest_list(spark, str(tmp_path / "none")) == (-1, {})


def test_vacuum_removes_replaced_folders(spark, tmp_path):
    root = str(tmp_path / "store")
    store.create(numbered_orders(spark, 40), root, key=["order_id"], buckets=4)
    for k in range(2):
        store.merge_orders(numbered_orders(spark, 40, revenue=str(k)).withColumn("seq", F.lit(1)), root, k, seq=["seq"])
    old = store.read(spark, root)
    assert store.vacuum(spark, root, keep=2) == 4
    assert store.vacuum(spark, root) == 4
    assert old.count() == store.read(spark, root).count() == 40


def test_empty_tables(spark, tmp_path):
    root = str(tmp_path / "store")
    store.create(numbered_orders(spark, 0), root, key=["order_id"], buckets=4)
    assert store.read(spark, root).count() == 0
    assert store.merge_orders(numbered_orders(spark, 0).withColumn("seq", F.lit(1)), root, 0, seq=["seq"]) == []
    assert len(store.merge_orders(numbered_orders(spark, 3).withColumn("seq", F.lit(1)), root, 1, seq=["seq"])) >= 1
    assert store.read(spark, root).count() == 3
