"""Latest entries of append-only logs (alerts, activity, payments)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame, key: str | Sequence[str], at: str, k: int, *, tie: Sequence[str] = ()
) -> DataFrame:
    """The ``k`` newest rows per key.

    The rank filter becomes a rank limit on both sides of the shuffle, so at most
    ``k`` rows per key leave each input task, however hot the key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    newest = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), *tie)
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= k).drop("_rn")
