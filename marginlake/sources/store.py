"""A keyed table that is merged into in place: copy on write by hash bucket.

The table lies in one folder for each bucket. A merge rewrites only the buckets
that have a key of the batch, each into a new folder, and commits by a new list
of the live folders; readers of the old list are not disturbed. A batch that the
list already counts changes nothing. The stored rows are not shuffled: the scan
has the partitioning of the key, only the batch is brought to it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginlake.schemas import AD_SPEND_KEY, ORDER_IMMUTABLE, ORDER_MUTABLE
from marginlake.sources import buckets as b
from marginlake.sources.merge import upsert

_PART = "_bucket"


def create(rows: DataFrame, root: str, *, key: Sequence[str], buckets: int) -> None:
    """Store ``rows`` (one row a key) as the first version under ``root``.

    ``buckets``: so many that one fits a task at the size the table will have.
    """
    spark = rows.sparkSession
    folders = _write(rows.repartition(buckets, *key), root, 0, key, buckets)
    content = {
        "key": list(key),
        "buckets": buckets,
        "schema": rows.schema.json(),
        "folders": {str(k): path for k, path in folders.items()},
        "batch": -1,
    }
    b.commit_list(spark, root, 0, content)


def _write(rows: DataFrame, root: str, version: int, key: Sequence[str], buckets: int) -> dict[int, str]:
    """Write the rows, partitioned by bucket, as folders of one version; bucket -> folder."""
    path = f"{root}/data/v{version}-{uuid.uuid4().hex}"  # a failed writer's folder is never written into
    b.write_folder(rows.withColumn(_PART, b.bucket_of(key, buckets)), path, key=key, buckets=buckets, split_by=[_PART])
    spark = rows.sparkSession
    return {int(n.split("=", 1)[1]): f"{path}/{n}" for n in b.names_in(spark, path) if n.startswith(f"{_PART}=")}


def _open(spark: SparkSession, content: dict, only: Sequence[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(content["schema"]))
    folders = {int(k): path for k, path in content["folders"].items() if only is None or int(k) in set(only)}
    return b.read_folders(spark, folders, schema, key=content["key"], buckets=content["buckets"], part=_PART)


def exists(spark: SparkSession, root: str) -> bool:
    return b.latest_list(spark, root)[0] >= 0


def read(spark: SparkSession, root: str, *, before: int | None = None) -> DataFrame:
    """The table as last committed, partitioned by its key; or as it was ``before`` a batch, if not vacuumed since."""
    version, content = b.latest_list(spark, root)
    while before is not None and content["batch"] >= before:
        version -= 1
        content = b.read_list(spark, root, version)
    return _open(spark, content).drop(_PART)


def columns_of(spark: SparkSession, root: str) -> list[str]:
    return T.StructType.fromJson(json.loads(b.latest_list(spark, root)[1]["schema"])).names


def last_batch(spark: SparkSession, root: str) -> int:
    return b.latest_list(spark, root)[1]["batch"]


def merge(
    batch: DataFrame,
    root: str,
    batch_id: int,
    *,
    immutable: Sequence[str],
    mutable: Sequence[str],
    seq: Sequence[str],
    on_conflict: Sequence[str] | None = None,
) -> list[int]:
    """Merge a batch (see ``merge.upsert``) into the table; returns the buckets that were rewritten.

    ``batch_id`` grows from batch to batch; one that is not above the last is a replay and is skipped.
    """
    spark = batch.sparkSession
    version, content = b.latest_list(spark, root)
    if batch_id <= content["batch"]:
        return []
    key, buckets = content["key"], content["buckets"]
    # At most one row for each bucket comes to the driver.
    touched = sorted(r[0] for r in batch.select(b.bucket_of(key, buckets)).distinct().collect())
    if touched:
        with b.passing_scans(spark):
            old = _open(spark, content, touched).drop(_PART)
            merged = upsert(old, batch, key=key, immutable=immutable, mutable=mutable, seq=seq, on_conflict=on_conflict, buckets=buckets)
            content["folders"] |= {str(k): path for k, path in _write(merged, root, version + 1, key, buckets).items()}
    b.commit_list(spark, root, version + 1, content | {"batch": batch_id})
    return touched


def merge_orders(batch: DataFrame, root: str, batch_id: int, *, seq: Sequence[str]) -> list[int]:
    """Orders: money, status and channel follow the latest row, the rest stays."""
    have = columns_of(batch.sparkSession, root)
    return merge(
        batch.select(*have, *[s for s in seq if s not in have]),
        root,
        batch_id,
        immutable=[c for c in have if c in ORDER_IMMUTABLE],
        mutable=[c for c in have if c in ORDER_MUTABLE],
        seq=seq,
    )


def merge_ad_spend(batch: DataFrame, root: str, batch_id: int, *, seq: Sequence[str]) -> list[int]:
    """Ad spend on (date, channel, campaign): the latest row replaces the old one."""
    have = columns_of(batch.sparkSession, root)
    measures = [c for c in have if c not in AD_SPEND_KEY]
    return merge(
        batch.select(*have, *[s for s in seq if s not in have]), root, batch_id, immutable=[], mutable=measures, seq=seq
    )


def vacuum(spark: SparkSession, root: str, *, keep: int = 1) -> int:
    """Remove folders that none of the newest ``keep`` lists names; returns how many went.

    Run it when no merge is under way and no reader is older than those lists.
    """
    newest, content = b.latest_list(spark, root)
    live = set(content["folders"].values())
    for n in range(max(0, newest - keep + 1), newest):
        live |= set(b.read_list(spark, root, n)["folders"].values())
    b.prune_lists(spark, root, keep)
    gone = [
        f"{root}/data/{v}/{part}"
        for v in b.names_in(spark, f"{root}/data")
        for part in b.names_in(spark, f"{root}/data/{v}")
        if part.startswith(f"{_PART}=")
    ]
    gone = [path for path in gone if path not in live]
    b.remove(spark, gone)
    return len(gone)
