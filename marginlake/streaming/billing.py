"""Billing webhooks folded into payments and the current plan per user."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marginlake.functions.money import dec
from marginlake.schemas import BILLING_EVENT
from marginlake.sources import store
from marginlake.sources.buckets import passing_scans

# Event names, plans, activity texts and the amount assumed when none is given.
CHECKOUT = "checkout.session.completed"
CANCELLED = "customer.subscription.deleted"
DEFAULT_PLAN = "pro"
CANCELLED_PLAN = "trial"
DEFAULT_CENTS = 49900
UPGRADED, UPGRADED_DETAIL = "billing.upgrade", "Upgraded to %s via Stripe"
ENDED, ENDED_DETAIL = "billing.canceled", "Subscription canceled — downgraded to Trial"


def parse_events(landed: DataFrame, body: str = "body") -> DataFrame:
    """JSON bodies as typed columns; other columns of ``landed`` are kept."""
    rest = [c for c in landed.columns if c != body]
    parsed = landed.select(*rest, F.from_json(body, BILLING_EVENT).alias("e"))
    return parsed.select(*rest, "e.type", "e.data.object.*").drop("e")


def _checkouts(events: DataFrame) -> DataFrame:
    """Completed checkouts of a known user (a positive whole number)."""
    user = F.coalesce("metadata.userId", "client_reference_id").try_cast("long")
    return (
        events.where(F.col("type") == CHECKOUT)
        .withColumn("user_id", user)
        .where(F.col("user_id") > 0)
    )


def payments(events: DataFrame) -> DataFrame:
    """One payment row per completed checkout."""
    cents = F.coalesce("amount_total", F.lit(DEFAULT_CENTS)).cast("decimal(18,0)")
    return _checkouts(events).select(
        "user_id",
        (cents * dec("0.01", 3, 2)).cast("decimal(14,2)").alias("amount"),
        F.coalesce("currency", F.lit("usd")).alias("currency"),
        F.coalesce("payment_status", F.lit("paid")).alias("status"),
        F.lit("stripe").alias("provider"),
        F.col("id").alias("provider_id"),
        "received_at",
    )


def _marks(events: DataFrame) -> DataFrame:
    """Checkouts of known users and cancellations of a customer: customer, user_id, at, ends, plan."""
    ends = F.col("type") == CANCELLED
    user = F.when(~ends, F.coalesce("metadata.userId", "client_reference_id").try_cast("long"))
    marks = events.where(F.col("type").isin(CHECKOUT, CANCELLED)).select(
        "customer",
        user.alias("user_id"),
        F.struct("received_at", "seq").alias("at"),
        ends.alias("ends"),
        F.when(ends, CANCELLED_PLAN).otherwise(F.coalesce("metadata.plan", F.lit(DEFAULT_PLAN))).alias("plan"),
    )
    return marks.where((F.col("ends") & F.col("customer").isNotNull()) | (F.col("user_id") > 0))


def _before(*key: str) -> WindowSpec:
    return Window.partitionBy(*key).orderBy("turn", "at").rowsBetween(Window.unboundedPreceding, -1)


def _owned(marks: DataFrame) -> DataFrame:
    """Marks with the user they concern; cancellations that concern none go.

    A cancellation names only the billing customer. It belongs to the user whose
    checkout named that customer last before it.
    """
    bought = F.when(~F.col("ends"), F.col("user_id"))
    # Checkouts without a customer own nothing: they stay with their user instead of meeting in one task.
    alone = F.when(F.col("customer").isNull(), F.col("user_id"))
    owner = F.last(bought, ignorenulls=True).over(_before("customer", "_alone"))
    owned = marks.withColumn("_alone", alone).withColumn("_owner", owner).drop("_alone")
    return (
        owned.withColumn("user_id", F.when(F.col("ends"), F.col("_owner")).otherwise(F.col("user_id")))
        .where(F.col("user_id").isNotNull())
        .drop("_owner")
    )


def _settled(owned: DataFrame) -> DataFrame:
    """Checkouts, and the cancellations that count: those of the customer that their user bought under last."""
    latest = F.last(F.when(~F.col("ends"), F.struct("customer")), ignorenulls=True).over(_before("user_id"))
    return (
        owned.withColumn("_latest", latest)
        .where(~F.col("ends") | (F.col("_latest.customer") == F.col("customer")))
        .drop("_latest")
    )


def _changes(events: DataFrame) -> DataFrame:
    """user_id, at, ends, plan of all that changes a plan: the events are read and parsed once."""
    return _settled(_owned(_marks(events).withColumn("turn", F.lit(1))))


def current_plans(events: DataFrame) -> DataFrame:
    """The plan each user ends up on: the latest of checkouts and the cancellations that hit the user."""
    last = _changes(events).groupBy("user_id").agg(F.max(F.struct("at", "plan")).alias("state"))
    return last.select("user_id", F.col("state.plan").alias("plan"), F.col("state.at.received_at").alias("changed_at"))


def activity(events: DataFrame) -> DataFrame:
    """The activity rows of upgrades and cancellations: user_id, action, detail, at."""
    ends = F.col("ends")
    return _changes(events).select(
        "user_id",
        F.when(ends, ENDED).otherwise(UPGRADED).alias("action"),
        F.when(ends, ENDED_DETAIL).otherwise(F.format_string(UPGRADED_DETAIL, "plan")).alias("detail"),
        F.col("at.received_at").alias("at"),
    )


# -- plans as keyed state -------------------------------------------------------

_AT = T.StructType([T.StructField("received_at", T.TimestampType()), T.StructField("seq", T.LongType())])
#: Who bought under a billing customer last.
OWNERS = T.StructType([T.StructField("customer", T.StringType()), T.StructField("user_id", T.LongType()), T.StructField("at", _AT)])
#: A user's latest billing customer and plan.
PLANS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("customer", T.StringType()),
        T.StructField("plan", T.StringType()),
        T.StructField("at", _AT),
    ]
)


def open_plans(spark: SparkSession, root: str, *, buckets: int = 16) -> None:
    """Create the state under ``root``, unless it is there."""
    for name, schema, key in (("owners", OWNERS, "customer"), ("plans", PLANS, "user_id")):
        if not store.exists(spark, f"{root}/{name}"):
            store.create(spark.createDataFrame([], schema), f"{root}/{name}", key=[key], buckets=buckets)


def _state(spark: SparkSession, path: str, batch_id: int, key: str, asked: DataFrame) -> DataFrame:
    """State rows of the keys asked for, as they were before the batch, as its first turn."""
    held = store.read(spark, path, before=batch_id)
    return held.join(asked.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_semi").withColumns(
        {"turn": F.lit(0), "ends": F.lit(False)}
    )


def fold_events(events: DataFrame, batch_id: int, root: str) -> None:
    """Take a batch of events into the state, in two steps: customers to owners, then users to plans.

    Reads and rewrites what the batch's customers and users touch; events of
    earlier batches are not read again. Batches come in order of arrival. A replay finds the state before
    it and the state after it as they were, and changes nothing.
    """
    spark = events.sparkSession
    marks = _marks(events).withColumn("turn", F.lit(1)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with passing_scans(spark):
            known = _state(spark, f"{root}/owners", batch_id, "customer", marks).withColumn("plan", F.lit(None).cast("string"))
            owned = _owned(marks.unionByName(known)).where("turn = 1").persist(StorageLevel.MEMORY_AND_DISK)
            users = _state(spark, f"{root}/plans", batch_id, "user_id", owned)
            settled = _settled(owned.unionByName(users))
            place = F.struct("turn", "at")
            plans = settled.groupBy("user_id").agg(
                F.max_by(F.struct("customer"), F.when(~F.col("ends"), place)).alias("_c"),
                F.max_by(F.struct("plan", "at"), place).alias("_p"),
            )
            plans = plans.select("user_id", "_c.customer", "_p.plan", "_p.at", F.lit(0).alias("_seq"))
            store.merge(plans, f"{root}/plans", batch_id, immutable=[], mutable=["customer", "plan", "at"], seq=["_seq"])
            owned.unpersist()
        bought = marks.where(~F.col("ends") & F.col("customer").isNotNull())
        owners = bought.groupBy("customer").agg(F.max(F.struct("at", "user_id")).alias("o"))
        owners = owners.select("customer", "o.user_id", "o.at", F.lit(0).alias("_seq"))
        store.merge(owners, f"{root}/owners", batch_id, immutable=[], mutable=["user_id", "at"], seq=["_seq"])
    finally:
        marks.unpersist()


def keep_plans(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep the state under ``root`` current from a stream of parsed events; drains what is there and stops."""
    open_plans(stream.sparkSession, root)
    return (
        stream.writeStream.foreachBatch(lambda df, batch: fold_events(df, batch, root))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def kept_plans(spark: SparkSession, root: str) -> DataFrame:
    """The plan of each user as of the last batch."""
    return store.read(spark, f"{root}/plans").select("user_id", "plan", F.col("at.received_at").alias("changed_at"))


def land_events(stream: DataFrame, path: str, checkpoint: str):
    """Append billing events as they arrive; plans and payments are folds of the log."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
