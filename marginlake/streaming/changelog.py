"""An order store fed by micro-batches: a levelled log of runs, bucketed and sorted by order id.

A micro-batch becomes a run of level 0, with one row a key. FANOUT runs of one
level are merged, bucket by bucket, into one run of the next level, so a row is
written once a level and the cost of compaction follows the log, not the store.
All runs have the same buckets, each one sorted file: readers and merges fold them by
key without moving them, and deltas join them without sorting. The list of live runs is committed in one step (see ``buckets``);
a replayed batch finds itself in it and does nothing. Folders that a merge has
replaced go with the commit after the next, so that readers of the last list are not disturbed.

With every batch go its signed deltas: what the rows that it changed were before
(sign -1) and are now (sign 1), from which running sums are corrected.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginlake import schemas
from marginlake.session import setting
from marginlake.sources import buckets as b
from marginlake.sources import validate
from marginlake.sources.merge import collapse

# Column that orders the rows of a micro-batch (file position, offset, event time).
SEQ = "_seq"
KEY = ("order_id",)
#: Buckets of a new store: so many that one fits a task at the size it will have.
BUCKETS = 48
#: Runs of one level that are merged into one of the next.
FANOUT = 4
#: Runs that deltas read in scans of their own.
JOINED = 12
_PART = "_run"

# The live feed corrects less than a re-import does.
LIVE_MUTABLE = ("gross_revenue", "status")
#: What a delta carries beside its sign.
DELTA = ("order_id", "order_date", "status", "gross_revenue", "cogs", "shipping_cost")


def _content(spark: SparkSession, root: str) -> tuple[int, dict]:
    version, content = b.latest_list(spark, root)
    if version < 0:
        content = {"buckets": BUCKETS, "last": list(LIVE_MUTABLE), "batch": -1, "runs": [], "deltas": [], "sums": None, "retired": []}
    return version, content


def _commit(spark: SparkSession, root: str, version: int, content: dict, retired: Sequence[str] = ()) -> None:
    """The next list; folders that the list before this one retired go."""
    b.commit_list(spark, root, version + 1, content | {"retired": list(retired)})
    b.remove(spark, content["retired"])
    b.prune_lists(spark, root, 2)


def _columns(last: Sequence[str]) -> tuple[list[str], list[str]]:
    """Columns that keep their first value, and those that follow the latest run."""
    rest = [f.name for f in schemas.ORDERS.fields if f.name not in KEY]
    return [c for c in rest if c not in last], [c for c in rest if c in last]


def _plain(rows: DataFrame, last: Sequence[str]) -> DataFrame:
    """Orders from the key and the structs ``_first`` and ``_last``."""
    first, _ = _columns(last)
    names = [f.name for f in schemas.ORDERS.fields]
    return rows.select(*[F.col(c) if c in KEY else F.col(f"_{'first' if c in first else 'last'}.{c}").alias(c) for c in names])


def _folded(runs: DataFrame, last: Sequence[str]) -> DataFrame:
    """One row a key from runs: ``last`` columns of the latest run, the others of the first one."""
    first, last = _columns(last)
    folded = runs.groupBy(*KEY).agg(
        F.min_by(F.struct(*first), F.col(_PART)).alias("_first"), F.max_by(F.struct(*last), F.col(_PART)).alias("_last")
    )
    return _plain(folded, last)


def _scan(spark: SparkSession, content: dict, runs: Sequence[dict]) -> DataFrame:
    """The rows of runs in one bucketed scan; ``_run`` grows with their age's end.

    A run has one sorted file a bucket; the setting lets scans of one run count as sorted, in
    plans that are made later too. Where a bucket has more files, Spark sorts.
    """
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    folders = {k: run["folder"] for k, run in enumerate(runs)}
    return b.read_folders(spark, folders, schemas.ORDERS, key=KEY, buckets=content["buckets"], part=_PART)


def _one_row_a_key(spark: SparkSession, content: dict, runs: Sequence[dict]) -> DataFrame:
    """The orders of neighbouring runs; a single one has a row a key already."""
    rows = _scan(spark, content, runs)
    return rows.drop(_PART) if len(runs) == 1 else _folded(rows, content["last"])


def _merged(spark: SparkSession, content: dict, runs: Sequence[dict]) -> DataFrame:
    """``_one_row_a_key`` that sorts the newer runs only: the oldest one, mostly the largest, is sorted as it lies."""
    if len(runs) == 1:
        return _one_row_a_key(spark, content, runs)
    first, last = _columns(content["last"])
    old, new = _one_row_a_key(spark, content, runs[:1]), _one_row_a_key(spark, content, runs[1:])
    sides = [rows.select(*KEY, F.struct(*first).alias(f"_f{k}"), F.struct(*last).alias(f"_l{k}")) for k, rows in enumerate((old, new))]
    both = sides[0].join(sides[1], list(KEY), "full_outer")
    # A struct is NULL only where its side has no such key.
    return _plain(both.select(*KEY, F.coalesce("_f0", "_f1").alias("_first"), F.coalesce("_l1", "_l0").alias("_last")), last)


def _current(spark: SparkSession, content: dict) -> DataFrame:
    if not content["runs"]:
        return spark.createDataFrame([], schemas.ORDERS)
    return _merged(spark, content, content["runs"])


def write_batch(raw: DataFrame, batch_id: int, root: str, source: str, at: Column | None = None) -> None:
    """Validate one micro-batch and land it as a run, its dead letters and its deltas; a replay does nothing.

    ``raw`` needs the column ``_seq``; other columns are checked as an order feed.
    ``at``: when the batch came (default: now).
    """
    spark = raw.sparkSession
    version, content = _content(spark, root)
    if batch_id <= content["batch"]:
        return
    # One time for the whole batch, also where lost parts of it are checked again.
    arrived = F.lit(dt.datetime.now(dt.timezone.utc)) if at is None else at
    # Read twice, not cached: reasons and payloads are made for the dead letters alone, and no batch is held.
    checked = validate.check_orders(raw, keep=(SEQ,))
    dead = validate.quarantined(checked, source).withColumn("failed_at", arrived)
    dead.write.mode("overwrite").parquet(f"{root}/dlq/batch={batch_id}")
    good = schemas.conform(validate.good_orders(checked).withColumn("created_at", arrived), schemas.ORDERS, keep=(SEQ,))
    first, last = _columns(content["last"])
    once = _plain(collapse(good, key=KEY, first=first, last=last, seq=[SEQ]), last)
    folder = f"{root}/runs/b{batch_id}-{uuid.uuid4().hex}"
    # The exchange that collapses the batch deals by key into as many parts as there are buckets: none comes after it.
    with setting(spark, "spark.sql.shuffle.partitions", str(content["buckets"])), setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        b.write_folder(once, folder, key=KEY, buckets=content["buckets"])
    run = {"folder": folder, "level": 0, "first": batch_id, "last": batch_id}
    deltas = f"{root}/deltas/b{batch_id}-{uuid.uuid4().hex}"
    with b.passing_scans(spark):
        _deltas(spark, content, run).write.parquet(deltas)
    content["runs"].append(run)
    content["deltas"].append({"folder": deltas, "batch": batch_id})
    _commit(spark, root, version, content | {"batch": batch_id})


def _deltas(spark: SparkSession, content: dict, run: dict) -> DataFrame:
    """Rows that the run changes, as they were (sign -1) and as they are with it (sign 1).

    Reads the columns of a delta from all runs, and joins them to the rows of the new one by
    key. Runs lie in the same buckets, sorted, so nothing moves, and what is in one file a
    bucket is not sorted again. Of more than JOINED runs, the newest are folded first.
    """
    fields = [f for f in schemas.ORDERS.fields if f.name in DELTA]
    last = [c for c in content["last"] if c in DELTA]
    first = [f.name for f in fields if f.name not in KEY and f.name not in last]
    parts = [[held] for held in content["runs"][: JOINED - 1]]
    if content["runs"][JOINED - 1 :]:
        parts.append(content["runs"][JOINED - 1 :])
    rows = _scan(spark, content, [run]).select(*KEY, F.struct(*first).alias("_first"), F.struct(*last).alias("new"))
    for k, part in enumerate(parts):
        held = _one_row_a_key(spark, content, part)
        rows = rows.join(held.select(*KEY, F.struct(*first).alias(f"_first{k}"), F.struct(*last).alias(f"_last{k}")), list(KEY), "left")
    # A struct is NULL only where its run has no such key.
    was = [F.col(f"_last{k}") for k in reversed(range(len(parts)))] or [F.lit(None).cast(rows.schema["new"].dataType)]
    both = rows.select(*KEY, F.coalesce(*[f"_first{k}" for k in range(len(parts))], "_first").alias("first"), F.coalesce(*was).alias("old"), "new")
    changed = both.where(F.col("old").isNull() | ~F.col("old").eqNullSafe(F.col("new")))
    signs = F.when(F.col("old").isNotNull(), F.array(F.lit(-1), F.lit(1))).otherwise(F.array(F.lit(1)))
    signed = changed.withColumn("sign", F.explode(signs))
    side = F.when(F.col("sign") < 0, F.col("old")).otherwise(F.col("new"))
    return signed.select(
        "sign", *[(F.col(c) if c in KEY else side[c] if c in last else F.col("first")[c]).alias(c) for c in DELTA]
    )


DELTA_SCHEMA = T.StructType(
    [T.StructField("sign", T.IntegerType()), *[next(f for f in schemas.ORDERS.fields if f.name == c) for c in DELTA]]
)


def deltas(spark: SparkSession, root: str, *, after: int = -1) -> DataFrame:
    """Signed rows (sign and the columns DELTA) of the batches after ``after`` that no sums have taken yet."""
    _, content = _content(spark, root)
    paths = [d["folder"] for d in content["deltas"] if d["batch"] > after]
    return spark.read.schema(DELTA_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], DELTA_SCHEMA)


def touched_days(spark: SparkSession, root: str, *, after: int = -1) -> DataFrame:
    """Days (column ``date``) of the orders that batches after ``after`` brought or changed: from the deltas alone."""
    return deltas(spark, root, after=after).select(F.to_date("order_date").alias("date")).distinct()


def fold_sums(spark: SparkSession, root: str, fold, schema: T.StructType) -> DataFrame:
    """Stored running sums with all deltas taken in: ``fold(sums or None, deltas)`` gives the new sums.

    The new sums and the list without the deltas that they took are one commit, so no
    delta is taken twice or lost.
    """
    version, content = _content(spark, root)
    held = spark.read.schema(schema).parquet(content["sums"]) if content["sums"] else None
    if content["deltas"]:
        path = f"{root}/sums/v{version + 1}-{uuid.uuid4().hex}"
        fold(held, deltas(spark, root)).select(*schema.names).write.parquet(path)
        old = [d["folder"] for d in content["deltas"]] + ([content["sums"]] if content["sums"] else [])
        _commit(spark, root, version, content | {"sums": path, "deltas": []}, old)
        held = spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema) if held is None else held


def current_orders(spark: SparkSession, root: str) -> DataFrame:
    """All orders as of the last complete micro-batch; no run is moved."""
    return _current(spark, _content(spark, root)[1])


def dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """Dead letters of all complete micro-batches."""
    _, content = _content(spark, root)
    if content["batch"] < 0:
        return spark.createDataFrame([], schemas.DLQ)
    rows = spark.read.schema(T.StructType([*schemas.DLQ.fields, T.StructField("batch", T.LongType())])).parquet(f"{root}/dlq")
    return rows.where(F.col("batch") <= content["batch"]).drop("batch")


def compact(spark: SparkSession, root: str, *, fanout: int = FANOUT) -> int:
    """Merge runs until no level has ``fanout`` of them; returns the number of the last batch.

    A merge reads and writes the runs of one level, never the store as a whole
    unless that level holds it. Runs of a level are neighbours in age: merging them keeps the order.
    """
    while True:
        version, content = _content(spark, root)
        levels: dict[int, list[dict]] = {}
        for run in content["runs"]:
            levels.setdefault(run["level"], []).append(run)
        full = [level for level, runs in sorted(levels.items()) if len(runs) >= fanout]
        if not full:
            return content["batch"]
        old = levels[full[0]]
        merged = {
            "folder": f"{root}/runs/l{full[0] + 1}-{uuid.uuid4().hex}",
            "level": full[0] + 1,
            "first": old[0]["first"],
            "last": old[-1]["last"],
        }
        with b.passing_scans(spark):
            b.write_folder(_merged(spark, content, old), merged["folder"], key=KEY, buckets=content["buckets"])
        runs = [run for run in content["runs"] if run["level"] != full[0]]
        at = sum(run["level"] > full[0] for run in runs)
        runs.insert(at, merged)
        _commit(spark, root, version, content | {"runs": runs}, [run["folder"] for run in old])
