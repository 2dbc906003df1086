"""Helpers shared by the text operators: words, hashes, tables, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marginlake.session import work_dir

#: Words are runs of anything but these; ``bytes.split()`` cuts at exactly these bytes.
SPACES = "\t\n\x0b\x0c\r "
#: The same rule as a regular expression for Spark and SQL.
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
#: Rows, and bytes, that a task handles at a time; one longer row is handled by itself.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20
#: Odd multiplier of the window hash.
STEP = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str, *, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back: cuts lineage, survives lost executors.

    A ``lasting`` table stays when the surrounding ``temporary`` ends.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    within = _TEMPORARY[:-1] if lasting else _TEMPORARY
    if within:
        within[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


_TEMPORARY: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within go when it ends, unless they are lasting."""
    _TEMPORARY.append([])
    try:
        yield
    finally:
        for path in _TEMPORARY.pop():
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashes(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=U64, count=len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finisher of MurmurHash3)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(STEP)
        out += h[j : j + n]
    return mix(out)


#: What tasks of one operator keep in a worker process for the next ones.
_KEPT: dict = {}


def kept(owner: str, key: str, build: Callable[[], object]):
    """What an earlier task of this worker process built for ``owner`` under ``key``, or a new one.

    Only one operator's things are kept at a time, so that workers do not grow.
    """
    release(owner)
    if (owner, key) not in _KEPT:
        _KEPT[owner, key] = build()
    return _KEPT[owner, key]


def release(owner: str | None = None) -> None:
    """Drop what other operators keep in this worker process."""
    for k in [k for k in _KEPT if k[0] != owner]:
        del _KEPT[k]


def give_back() -> None:
    """Return memory that is free in this worker process to the system; idle workers would keep it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim  # glibc has it
except (OSError, AttributeError):
    _TRIM = None


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, SLICE_ROWS or about SLICE_BYTES at a time."""
    for batch in batches:
        rows = batch.num_rows
        ends = _row_ends(batch)
        at = 0
        while at < rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right"))
            upto = min(max(upto, at + 1), at + SLICE_ROWS, rows)
            yield batch.slice(at, upto - at)
            at = upto
    batch = None
    give_back()


def _row_ends(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the texts and binaries of the rows up to each one."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return np.cumsum(sizes)


def by_batch(
    df: DataFrame,
    make: Callable[[], Callable[[dict[str, pa.Array]], dict]],
    schema: str | list[tuple] | T.StructType,
    owner: str | None = None,
) -> DataFrame:
    """``mapInArrow`` whose function turns the columns of a batch into the columns of a batch.

    ``make`` runs once per task, so that it can build what all batches share.
    A batch is handled in slices of bounded rows and bytes, which bounds the
    Python objects that exist at a time.
    ``owner``: whose things in the worker process stay, see ``kept``.
    ``schema``: as ``struct`` takes it, or pairs of name and kind or Spark type.
    """
    fields = _fields(schema)
    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(owner)
        step = make()
        for part in slices(batches):
            cols = step(dict(zip(part.schema.names, part.columns, strict=True)))
            yield pa.RecordBatch.from_arrays([_column(cols[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, fields)


def _column(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


_KINDS = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "longs": T.ArrayType(T.LongType()),
    "ints": T.ArrayType(T.IntegerType()),
    "doubles": T.ArrayType(T.DoubleType()),
}


def struct(columns: str) -> T.StructType:
    """A schema from ``name kind, ...``; needs no session, so modules may use it in tasks."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split() for c in columns.split(","))])


def _fields(schema: str | list[tuple] | T.StructType) -> T.StructType:
    if isinstance(schema, (str, T.StructType)):
        return struct(schema) if isinstance(schema, str) else schema
    return T.StructType([T.StructField(n, t if isinstance(t, T.DataType) else _KINDS[t]) for n, t in schema])
