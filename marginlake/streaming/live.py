"""Live daily unit economics over order and ad-spend streams."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginlake.functions.money import money_sum, ratio_or_zero
from marginlake.operators.staging import COMPLETED
from marginlake.streaming import changelog


def daily_flows(
    orders: DataFrame,
    ads: DataFrame,
    *,
    completed: str = COMPLETED,
    delay: str = "3 days",
) -> DataFrame:
    """Running sums per day: orders, revenue, margin and spend.

    Completed orders are de-duplicated by id within the watermark, so an order
    counts once it is first seen completed; what changes later, or comes too late, is corrected by
    ``corrected_days``. Orders and spend are
    signed flows of one stream, so one stateful aggregate replaces the outer join.
    Rows later than ``delay`` behind the newest event are dropped. State holds the
    ids of ``delay`` days and one row per open day.
    """
    zero = F.lit(0).cast("decimal(12,2)")
    done = (
        orders.where(F.col("status") == completed)
        .withColumn("at", F.col("order_date").cast("timestamp"))
        .withWatermark("at", delay)
        .dropDuplicatesWithinWatermark(["order_id"])
    )
    margin = F.col("gross_revenue") - F.col("cogs") - F.col("shipping_cost")
    sold = done.select(
        "at",
        F.lit(1).cast("long").alias("n"),
        F.col("gross_revenue").cast("decimal(12,2)").alias("revenue"),
        margin.cast("decimal(14,2)").alias("margin"),
        zero.alias("spend"),
    )
    spent = (
        ads.withColumn("at", F.col("date").cast("timestamp"))
        .withWatermark("at", delay)
        .select(
            "at",
            F.lit(0).cast("long").alias("n"),
            zero.alias("revenue"),
            zero.cast("decimal(14,2)").alias("margin"),
            F.col("spend").cast("decimal(12,2)").alias("spend"),
        )
    )
    return (
        sold.unionByName(spent)
        .groupBy(F.window("at", "1 day").alias("day"))
        .agg(
            F.sum("n").alias("n"),
            *[money_sum(c).alias(c) for c in ("revenue", "margin", "spend")],
        )
        .select(F.to_date("day.start").alias("date"), "n", "revenue", "margin", "spend")
    )


def economics_of(flows: DataFrame) -> DataFrame:
    """Finished daily columns from running sums; no state, usable in any sink."""
    return flows.select(
        "date",
        F.col("n").alias("total_orders"),
        F.col("revenue").alias("total_revenue"),
        F.col("spend").alias("total_ad_spend"),
        (F.col("margin") - F.col("spend")).alias("net_profit"),
        ratio_or_zero(F.col("spend"), F.col("n")).alias("blended_cac"),
        ratio_or_zero(F.col("revenue"), F.col("spend")).alias("blended_roas"),
    )


def save_updates(flows: DataFrame, path: str, checkpoint: str, *, once: bool = True):
    """Write changed days per micro-batch, one folder each, safe to replay."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = (
        flows.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def latest_days(updates: DataFrame) -> DataFrame:
    """The newest version of each day from the saved updates."""
    row = F.struct("n", "revenue", "margin", "spend")
    return updates.groupBy("date").agg(F.max_by(row, F.col("batch")).alias("r")).select("date", "r.*")


#: Running sums of completed orders by day.
ORDER_SUMS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("n", T.LongType()),
        T.StructField("revenue", T.DecimalType(20, 2)),
        T.StructField("margin", T.DecimalType(20, 2)),
    ]
)


def add_deltas(sums: DataFrame | None, deltas: DataFrame, *, completed: str = COMPLETED) -> DataFrame:
    """Sums by day with signed rows (see ``changelog``) taken in: old rows go out, new ones come in."""
    counted = deltas.where(F.col("status") == completed)
    sign = F.col("sign").cast("long")
    margin = F.col("gross_revenue") - F.col("cogs") - F.col("shipping_cost")
    rows = counted.select(
        F.to_date("order_date").alias("date"),
        sign.alias("n"),
        F.when(sign > 0, F.col("gross_revenue")).otherwise(-F.col("gross_revenue")).cast("decimal(20,2)").alias("revenue"),
        F.when(sign > 0, margin).otherwise(-margin).cast("decimal(20,2)").alias("margin"),
    )
    if sums is not None:
        rows = rows.unionByName(sums)
    return rows.groupBy("date").agg(F.sum("n").alias("n"), money_sum("revenue").alias("revenue"), money_sum("margin").alias("margin"))


def corrected_days(spark: SparkSession, root: str, ads: DataFrame, *, completed: str = COMPLETED) -> DataFrame:
    """Daily economics of the order store under ``root`` as of its last batch, and of ``ads``.

    Takes the deltas of the batches since the last call into the stored sums: what
    changed long ago, or came late, is corrected without reading the orders again. Days that
    neither sold nor spent anything are left out.
    """
    sums = changelog.fold_sums(spark, root, partial(add_deltas, completed=completed), ORDER_SUMS)
    spent = ads.groupBy(F.to_date("date").alias("date")).agg(money_sum("spend").alias("spend"))
    days = sums.where("n > 0").join(spent, "date", "full_outer")
    return economics_of(days.na.fill(0, ["n", "revenue", "margin", "spend"]))
