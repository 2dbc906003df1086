"""Stored tables of bucketed folders with a list of the folders that are live.

A folder holds rows bucketed and sorted by a key, always into the same number of
buckets, so that a scan over any of a table's folders keeps that partitioning:
joins and aggregates by the key do not move what is stored. What a table
consists of is said by its list alone (``lists/<version>.json``); a commit writes
the next list beside it and renames it into place, and fails if another writer
was first. Folders that no list names are left-overs of failed writers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_SCANS: list[list[str]] = [[]]


def forget(spark: SparkSession) -> None:
    """Drop the catalog entries of all scans so far; their files stay, frames over them can no longer run."""
    for name in _SCANS[-1]:
        spark.sql(f"drop table if exists {name}")
    _SCANS[-1].clear()


@contextmanager
def passing_scans(spark: SparkSession) -> Iterator[None]:
    """Scans that are opened within serve this block only."""
    _SCANS.append([])
    try:
        yield
    finally:
        forget(spark)
        _SCANS.pop()


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    """The bucket that Spark's own bucketing gives a row."""
    return F.pmod(F.hash(*key), F.lit(buckets))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


def write_folder(
    df: DataFrame, path: str, *, key: Sequence[str], buckets: int, split_by: Sequence[str] = ()
) -> None:
    """``df`` as a bucketed folder, in sub-folders by ``split_by``; replaces what is there."""
    name = _name("marginlake_write")
    writer = df.write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).option("path", path)
    if split_by:
        writer = writer.partitionBy(*split_by)
    try:
        writer.saveAsTable(name)
    finally:
        df.sparkSession.sql(f"drop table if exists {name}")  # the catalog's entry; the files stay


def read_folders(
    spark: SparkSession,
    folders: Mapping[int, str],
    schema: T.StructType,
    *,
    key: Sequence[str],
    buckets: int,
    part: str = "part",
) -> DataFrame:
    """One bucketed scan over ``folders``; the int column ``part`` says which one a row is from.

    Filters on ``part`` keep other folders from being read.
    """
    if not folders:
        return spark.createDataFrame([], schema.add(part, T.IntegerType()) if part not in schema.names else schema)
    # A scan looks its folders up when it runs, so its catalog entry stays until ``forget``,
    # or until the surrounding ``passing_scans`` ends.
    name = _name("marginlake_scan")
    _SCANS[-1].append(name)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != part)
    by = ", ".join(f"`{c}`" for c in key)
    some = next(iter(folders.values())).rsplit("/", 1)[0]
    spark.sql(
        f"create table {name} ({columns}, `{part}` int) using parquet partitioned by (`{part}`) "
        f"clustered by ({by}) sorted by ({by}) into {buckets} buckets location {_quoted(some + '/none')}"
    )
    entries = " ".join(f"partition (`{part}` = {k}) location {_quoted(path)}" for k, path in folders.items())
    spark.sql(f"alter table {name} add {entries}")
    return spark.table(name)


# -- lists of live folders ------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    at, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def read_list(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(f"{root}/lists/{version:010d}.json").first()["value"])


def latest_list(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the newest list; (-1, {}) before the first commit."""
    numbers = [int(n.removesuffix(".json")) for n in names_in(spark, f"{root}/lists") if n.endswith(".json") and n[0] not in "._"]
    return (max(numbers), read_list(spark, root, max(numbers))) if numbers else (-1, {})


def commit_list(spark: SparkSession, root: str, version: int, content: dict) -> None:
    """Make ``content`` list number ``version``; FileExistsError if another writer has it already."""
    jvm = spark.sparkContext._jvm
    target, fs = _fs(spark, f"{root}/lists/{version:010d}.json")
    draft, _ = _fs(spark, f"{root}/lists/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    # FileContext renames in one step and refuses to replace a list that is there.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
    except Exception as failed:
        fs.delete(draft, False)
        if fs.exists(target):
            raise FileExistsError(f"another writer committed version {version} of {root}") from failed
        raise


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    for path in paths:
        at, fs = _fs(spark, path)
        fs.delete(at, True)


def prune_lists(spark: SparkSession, root: str, keep: int) -> None:
    """Drop lists but for the newest ``keep``."""
    names = sorted(n for n in names_in(spark, f"{root}/lists") if n.endswith(".json") and n[0] not in "._")
    remove(spark, [f"{root}/lists/{n}" for n in names[:-keep]])
