"""Throttle audit: fixed windows per key, anchored at the first event.

A window opens with an event later than the end of the key's previous window and
lasts ``window`` seconds; of its events the first ``limit`` are allowed.

Every event knows the event that would open the next window, were it to open one
itself: the first one later than its own time plus the window. The events that do
open windows are those reached from the start of a chain, and a chain starts
wherever a key was silent for longer than a window. Reached sets double their
stride with every round, so rounds grow with the logarithm of the longest chain,
whatever the length of the calendar. Neighbours in time are found within ranges of
key and time, so that the events of one key are spread like those of many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _moment(micros: Column) -> Column:
    return F.timestamp_micros(micros)


def _successors(times: DataFrame, span: int, root: str) -> DataFrame:
    """key, t, next (the first event later than t + span, if any), starts (nothing in the span before t).

    ``times``: distinct key, t (microseconds). Events and the questions at
    t + span are range-sorted by key and time, so that a hot key's are spread
    over many partitions. A partition answers from its own rows; what lies in later or earlier ones comes
    from their edges, one row for each key and partition.
    """
    t, event = F.col("t"), F.when(F.col("asks") == 0, F.col("t"))
    rows = times.select("key", "t", F.lit(0).alias("asks")).unionByName(
        times.select("key", (t + span).alias("t"), F.lit(1).alias("asks"))
    )
    ranged = rows.repartitionByRange("key", "t", "asks").withColumn("part", F.spark_partition_id())
    ranged = _stored(ranged, f"{root}/ranged")
    ends = ranged.groupBy("key", "part").agg(F.min(event).alias("low"), F.max(event).alias("high"))
    later = Window.partitionBy("key").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    edges = ends.select("key", "part", F.min("low").over(later).alias("after"), F.max("high").over(earlier).alias("ahead"))
    edges = _stored(edges, f"{root}/edges")
    # Backwards in time the least event so far is the nearest later one; a question
    # at the very time of an event comes before it and does not see it.
    own = Window.partitionBy("part", "key")
    behind = own.orderBy(F.col("t").desc(), F.col("asks").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = own.orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, -1)
    looked = ranged.withColumn("next", F.min(event).over(behind)).withColumn("before", F.max(event).over(before))
    answers = looked.join(edges, ["key", "part"]).groupBy("key", F.when(F.col("asks") == 1, t - span).otherwise(t).alias("t"))
    return answers.agg(
        F.max(F.when(F.col("asks") == 1, F.coalesce("next", "after"))).alias("next"),
        F.max(F.when(F.col("asks") == 0, F.coalesce("before", "ahead"))).alias("before"),
    ).select("key", "t", "next", (F.col("before").isNull() | (t - F.col("before") > span)).alias("starts"))


def window_starts(times: DataFrame, span: int, root: str) -> DataFrame:
    """key, t of every event that opens a window; tables of each round go to ``root``."""
    linked = _stored(_successors(times, span, root), f"{root}/linked")
    reached = linked.where("starts").select("key", "t")
    jumps = linked.where("next is not null").select("key", "t", "next")
    known, k = -1, 0
    while True:
        reached = _stored(reached, f"{root}/reached-{k}")
        count = reached.count()
        if count == known:
            return reached
        known, k = count, k + 1
        ahead = reached.join(jumps, ["key", "t"]).select("key", F.col("next").alias("t"))
        onward = jumps.select("key", F.col("t").alias("next"), F.col("next").alias("then"))
        jumps = _stored(
            jumps.join(onward, ["key", "next"]).select("key", "t", F.col("then").alias("next")), f"{root}/jumps-{k}"
        )
        reached = reached.unionByName(ahead).distinct()


def audit(events: DataFrame, root: str, *, key: str, at: str, limit: int, window: int) -> DataFrame:
    """Windows per key with their events, allowed and rejected counts.

    ``root`` is a shared folder for the tables of the rounds. Events are counted
    per key and instant first; only instants are linked and joined. Events
    without a time are left out; a null key is a key like any other.
    """
    span = window * MICROS
    none = F.col(key).isNull()
    t = F.unix_micros(F.col(at).cast("timestamp"))
    counted = events.where(F.col(at).isNotNull()).groupBy(
        F.when(none, "-").otherwise(F.concat(F.lit("="), F.col(key).cast("string"))).alias("key"), t.alias("t")
    )
    instants = _stored(
        counted.agg(F.count("*").alias("events")).withColumn("slot", F.floor(F.col("t") / span)), f"{root}/instants"
    )
    starts = window_starts(instants.select("key", "t"), span, root)
    # Slots are as long as windows: each holds at most one start, and a window reaches into the next slot at most.
    opened = starts.select("key", F.floor(F.col("t") / span).alias("slot"), F.col("t").alias("anchor"))
    here = opened.withColumn("shift", F.lit(0))
    there = opened.select("key", (F.col("slot") + 1).alias("slot"), "anchor", F.lit(1).alias("shift"))
    both = here.unionByName(there).groupBy("key", "slot").agg(
        F.max(F.when(F.col("shift") == 0, F.col("anchor"))).alias("own"),
        F.max(F.when(F.col("shift") == 1, F.col("anchor"))).alias("earlier"),
    )
    placed = instants.join(both, ["key", "slot"]).withColumn(
        "anchor", F.when(F.col("own") <= F.col("t"), F.col("own")).otherwise(F.col("earlier"))
    )
    allowed = F.least(F.col("events"), F.lit(limit).cast("long"))
    return (
        placed.groupBy("key", "anchor")
        .agg(F.sum("events").alias("events"))
        .select(
            F.when(F.col("key") != "-", F.substring("key", 2, 2_000_000_000)).alias("key"),
            _moment(F.col("anchor")).alias("window_start"),
            "events",
            allowed.alias("allowed"),
            (F.col("events") - allowed).alias("rejected"),
        )
    )
