"""Positions of all rows of a table in a whole order, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginlake.session import work_dir

#: monotonically_increasing_id counts the rows of a partition in these low bits.
_ROW_BITS = 33


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[Column], column: str = "position") -> DataFrame:
    """``df`` with the place (1, 2, ...) of every row in ``order``.

    A range sort spreads the rows over partitions, each row keeps its number
    within its partition, and the counts of the partitions before it are its
    offset. Only the counts (one row a partition) meet in one task. ``df`` is
    read twice, once to find the ranges: store it first if it is dear. Rows
    equal in ``order`` are numbered in any order: end it with a key.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = _stored(ranged.withColumn("__place", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("__place", _ROW_BITS)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # Stored, so that its size is known: broadcast if small, else joined by sorting.
    offsets = _stored(counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")), "offsets")
    within = F.col("__place").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        rows.join(offsets, part == F.col("__part"))
        .withColumn(column, within + F.col("__before") + 1)
        .drop("__place", "__part", "__before")
    )
