"""Sinks: marts, bucketed tables, CSV exports, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginlake.operators.customers import segment_customers
from marginlake.sources.buckets import names_in, remove
from marginlake.sources.validate import counted

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso_text(c: Column) -> Column:
    """UTC text of an instant, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()), ISO_MILLIS)


def save_mart(
    df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """Write a mart as Parquet, optionally in folders by its leading key."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def save_bucketed(df: DataFrame, table: str, *, key: str = "order_id", buckets: int) -> None:
    """A table bucketed and sorted on its merge key: later merges do not shuffle it.

    ``buckets``: so many that one bucket fits a task, at the size the table will have.
    """
    (
        df.repartition(buckets, key)
        .write.mode("overwrite")
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(table)
    )


def refresh_days(mart: DataFrame, days: DataFrame, path: str, *, key: str = "date") -> None:
    """Replace the folders of ``days`` (column ``key``) in a mart that is stored by day; others are not touched.

    ``mart`` has the new rows of these days, and of no others. A day that has no rows any more loses
    its folder: one row for each such day comes to the driver.
    """
    spark = mart.sparkSession
    spread = mart.repartition(key)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    left = spark.read.parquet(path).select(key).distinct() if mart_exists(spark, path) else None
    if left is not None:
        now = mart.select(key).distinct()
        gone = days.select(F.col(key).cast("date").alias(key)).distinct().join(left, key, "left_semi").join(now, key, "left_anti")
        remove(spark, [f"{path}/{key}={r[key]}" for r in gone.collect()])


def mart_exists(spark: SparkSession, path: str) -> bool:
    """Whether a mart stored by folders has any."""
    return any("=" in n for n in names_in(spark, path))


def save_checked(checked: DataFrame, path: str, source: str) -> dict[str, int]:
    """Write good rows and dead letters in one pass; returns the counters of that very write.

    ``path`` gets ``good=true`` with the typed rows and ``good=false`` with source_system, raw_payload, error_reason.
    """
    seen, observation = counted(checked)
    typed = [c for c in checked.columns if not c.startswith("_")]
    bad = lambda c: F.when(~F.col("_ok"), c)
    rows = seen.select(
        *[F.when(F.col("_ok"), F.col(c)).alias(c) for c in typed],
        bad(F.lit(source)).alias("source_system"),
        bad(F.col("_payload")).alias("raw_payload"),
        bad(F.array_join("_reasons", "; ")).alias("error_reason"),
        F.col("_ok").alias("good"),
    )
    rows.write.mode("overwrite").partitionBy("good").parquet(path)
    return {k: int(v) for k, v in observation.get.items()}


def append_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").parquet(path)


def save_alerts(alerts: DataFrame, path: str, batch: int, *, key: Sequence[str] = ("date", "title")) -> None:
    """Save a scan's alerts under its number: each alert once, whatever is run again.

    A replay overwrites its own folder. Alerts (by ``key``) that an earlier scan
    saved are left out; only the keys of these are read.
    """
    spark = alerts.sparkSession
    name = F.sha2(F.to_json(F.struct(*key)), 256)
    named = alerts.withColumn("alert_key", name).dropDuplicates(["alert_key"])
    earlier = [n for n in names_in(spark, path) if n.startswith("batch=") and int(n.split("=", 1)[1]) < batch]
    if earlier:
        known = spark.read.schema("alert_key string").parquet(*[f"{path}/{n}" for n in earlier])
        named = named.join(known, "alert_key", "left_anti")
    named.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """All saved alerts, with the number of the scan that raised them first."""
    return spark.read.parquet(path)


def _write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def customer_export(customers: DataFrame, *, as_of: Column) -> DataFrame:
    """name, email, segment, orders, ltv, first and last order; segments as of now."""
    return segment_customers(customers, as_of=as_of).select(
        "name",
        "email",
        F.col("segment_label").alias("segment"),
        F.col("order_count").alias("orders"),
        F.col("total_spend").alias("ltv"),
        iso_text(F.col("first_order_at")).alias("first_order_at"),
        iso_text(F.col("last_order_at")).alias("last_order_at"),
    )


def order_export(orders: DataFrame) -> DataFrame:
    """order_number, channel, status, revenue, cogs, shipping, created_at."""
    return orders.select(
        F.col("order_id").alias("order_number"),
        F.col("acquisition_channel").alias("channel"),
        "status",
        F.col("gross_revenue").alias("revenue"),
        "cogs",
        F.col("shipping_cost").alias("shipping"),
        iso_text(F.col("order_date")).alias("created_at"),
    )


def export_customers_csv(customers: DataFrame, path: str, *, as_of: Column) -> None:
    _write_csv(customer_export(customers, as_of=as_of), path)


def export_orders_csv(orders: DataFrame, path: str) -> None:
    """Orders by time: range-partitioned sort, so part files are in global order."""
    _write_csv(order_export(orders).orderBy("created_at", "order_number"), path)
