import random

import pytest
from pyspark.sql import functions as F

from marginlake.operators import sketches, staging
from marginlake.operators.positions import numbered
from tests.helpers import dicts, order, orders_frame


@pytest.mark.parametrize("parts", [1, 7])
def test_positions_follow_the_whole_order(spark, parts):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([None, 1, 2, 3]), rnd.choice("ab")) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, a int, b string").repartition(parts)
    got = dicts(numbered(df, [F.col("a").desc_nulls_last(), F.col("b").asc(), F.col("id").asc()]), "position")
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))
    assert [r["position"] for r in got] == list(range(1, 501))
    assert [(r["id"], r["a"], r["b"]) for r in got] == want


def test_positions_of_nothing(spark):
    df = spark.createDataFrame([], "a int")
    found = numbered(df, [F.col("a").asc()], "place")
    assert found.columns == ["a", "place"] and found.count() == 0


def test_sketches_merge_within_their_error(spark):
    rows = [order(i, customer=f"c{i % 700}", day=f"2025-0{1 + i % 3}-01") for i in range(3000)]
    daily = sketches.daily_sketches(staging.stage_orders(orders_frame(spark, rows)))
    total = dicts(sketches.approximate_customers(daily))[0]
    assert total["orders"] == 3000 and abs(total["customers"] - 700) <= 4 * sketches.ERROR * 700
    months = dicts(sketches.approximate_customers(daily, period=F.month("date").alias("m")), "m")
    assert [r["orders"] for r in months] == [1000] * 3
