"""Idempotent keyed merge of order and ad-spend batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginlake.schemas import AD_SPEND_KEY, ORDER_IMMUTABLE, ORDER_MUTABLE


def collapse(
    batch: DataFrame,
    *,
    key: Sequence[str],
    first: Sequence[str],
    last: Sequence[str],
    seq: Sequence[str],
) -> DataFrame:
    """One row per key: ``first`` columns of the earliest row, ``last`` of the latest.

    Rows of one place in ``seq`` are told apart by a hash of their content, so that
    reruns agree. A plain aggregate that carries the chosen columns only: copies of
    a hot key are folded inside each input task before the shuffle.
    """
    tie = F.xxhash64(*sorted(c for c in batch.columns if c not in seq))
    place = [*[F.col(c) for c in seq], tie.alias("_tie")]
    aggs = [F.max(F.struct(*place, F.struct(*last).alias("row"))).alias("_l")]
    out = [F.col("_l.row").alias("_last")]
    if first:
        aggs.append(F.min(F.struct(*place, F.struct(*first).alias("row"))).alias("_f"))
        out.insert(0, F.col("_f.row").alias("_first"))
    return batch.groupBy(*key).agg(*aggs).select(*key, *out)


def upsert(
    target: DataFrame,
    batch: DataFrame,
    *,
    key: Sequence[str],
    immutable: Sequence[str],
    mutable: Sequence[str],
    seq: Sequence[str],
    on_conflict: Sequence[str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """``target`` with ``batch`` merged in; ``target`` has unique keys and keeps them.

    New keys take all columns from the batch. Known keys take only ``on_conflict``
    (default: all ``mutable``) and keep the rest. The batch is collapsed first, so
    both sides of the join are unique on the key and cannot be skewed by it. A
    target that has ``buckets`` buckets on the key joins without moving: the
    collapsed batch is brought to them.
    """
    update = list(mutable if on_conflict is None else on_conflict)
    keep = [c for c in [*immutable, *mutable] if c not in update]
    changes = collapse(batch, key=key, first=keep, last=update, seq=seq)
    if buckets:
        changes = changes.repartition(buckets, *key)
    parts = [F.struct(*update).alias("_old_last")]
    if keep:
        parts.append(F.struct(*keep).alias("_old_first"))
    held = target.select(*key, *parts)
    merged = held.join(changes, list(key), "full_outer")
    # A struct is NULL only where its side had no such key.
    last = F.coalesce("_last", "_old_last")
    first = F.coalesce("_old_first", "_first") if keep else None
    columns = {c: first[c] for c in keep} | {c: last[c] for c in update}
    return merged.select(
        *key, *[columns[c].alias(c) for c in target.columns if c not in key]
    )


def upsert_orders(target: DataFrame, batch: DataFrame, *, seq: Sequence[str]) -> DataFrame:
    """Order merge: money, status and channel follow the latest row, the rest stays."""
    have = [c for c in target.columns if c != "order_id"]
    return upsert(
        target,
        batch.select("order_id", *have, *[s for s in seq if s not in target.columns]),
        key=["order_id"],
        immutable=[c for c in have if c in ORDER_IMMUTABLE],
        mutable=[c for c in have if c in ORDER_MUTABLE],
        seq=seq,
    )


def upsert_ad_spend(target: DataFrame, batch: DataFrame, *, seq: Sequence[str]) -> DataFrame:
    """Ad-spend merge on (date, channel, campaign): the latest row replaces the old one."""
    measures = [c for c in target.columns if c not in AD_SPEND_KEY]
    return upsert(
        target,
        batch.select(*AD_SPEND_KEY, *measures, *[s for s in seq if s not in target.columns]),
        key=list(AD_SPEND_KEY),
        immutable=[],
        mutable=measures,
        seq=seq,
    )
