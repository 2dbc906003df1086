"""WARC archives as a chunked record table.

A payload is rows of (record, chunk number, bytes). Each row carries the length
and the SHA-1 of the payload up to its end, so the last row of a record has
those of the whole. Writer and reader pass chunk by chunk: neither ever holds a
whole payload, so a record may be larger than a task's memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marginlake.llm.common import store, struct
from marginlake.session import work_dir

CHUNK_BYTES = 1 << 20
#: A task begins a new archive file behind this many compressed bytes.
ARCHIVE_BYTES = 256 << 20
#: Payloads below this size are stored again rather than referred to.
REVISIT_BYTES = 1000

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"

CHUNKS = struct(
    "record_id string, uri string, chunk_no long, data binary, end_byte long, sha1 string, last boolean, "
    "payload_digest string, row_no long"
)
#: What the reader knows of a record besides its chunks.
READ = struct(
    "archive string, offset long, record_type string, record_id string, uri string, refers_to string, "
    "payload_bytes long, payload_digest string, chunk_no long, data binary, end_byte long, sha1 string, last boolean"
)


class Digest:
    """Length and SHA-1 of the bytes so far."""

    def __init__(self):
        self.sha, self.size = hashlib.sha1(), 0

    def add(self, data: bytes) -> tuple[int, str]:
        self.sha.update(data)
        self.size += len(data)
        return self.size, self.sha.hexdigest()


def pieces(data: bytes, size: int) -> Iterator[tuple[int, bytes, bool]]:
    """Number, bytes and whether it is the last, for each chunk; no bytes are one empty chunk."""
    for k in range(0, max(len(data), 1), size):
        yield k // size, data[k : k + size], k + size >= len(data)


def _batches(rows: Iterable[tuple], schema: T.StructType, data_at: int, limit: int = 8 << 20):
    """Rows as Arrow batches of a few MB, whatever the size of a row."""
    target, held, size = to_arrow_schema(schema), [], 0
    for row in rows:
        held.append(row)
        size += len(row[data_at] or b"") + 200
        if size >= limit:
            yield _batch(held, target)
            held, size = [], 0
    if held:
        yield _batch(held, target)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target
    )


def chunk_table(rows: DataFrame, record_id: str, uri: str, payload: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of text or bytes as chunk rows. Null payloads are empty: one chunk of no bytes.

    Null ids and addresses stay null. Rows of one id are records of their own:
    every chunk carries its row's number and whole payload's digest, by which
    they are told apart. ``sha1`` is the digest up to the chunk's end.
    """

    def run(batches):
        def rows_of():
            for batch in batches:
                for rid, at, body, row in zip(*batch.columns, strict=True):
                    digest, payload = Digest(), body.as_py() or b""
                    whole = hashlib.sha1(payload).hexdigest()
                    for k, data, last in pieces(payload, chunk_bytes):
                        size, sha = digest.add(data)
                        yield rid.as_py(), at.as_py(), k, data, size, sha, last, whole, row.as_py()

        yield from _batches(rows_of(), CHUNKS, 3)

    body = F.col(payload)
    if not isinstance(rows.schema[payload].dataType, T.BinaryType):
        body = F.encode(body.cast("string"), "UTF-8")
    columns = F.col(record_id).cast("string"), F.col(uri).cast("string"), body, F.monotonically_increasing_id()
    return rows.select(*columns).mapInArrow(run, CHUNKS)


def heads(chunks: DataFrame) -> DataFrame:
    """Length and digest of every whole payload: what its last chunk carries."""
    return chunks.filter("last").select(
        "record_id", F.col("end_byte").alias("payload_bytes"), F.col("sha1").alias("payload_digest")
    )


def plan_revisits(records: DataFrame, order: str = "record_id", least: int = REVISIT_BYTES) -> DataFrame:
    """Add ``refers_to``: of equal payloads of ``least`` bytes or more, the record with the largest ``order``.

    Null for that record and for smaller payloads. One aggregate with a
    map-side combine, and a join that can be split where one payload is hot.
    """
    key = [F.col("payload_digest"), F.col("payload_bytes")]
    kept = (
        records.filter(F.col("payload_bytes") >= least)
        .groupBy(*key)
        .agg(F.max(order).alias("__kept"))
    )
    joined = records.join(kept, ["payload_digest", "payload_bytes"], "left")
    other = F.col("__kept") != F.coalesce(F.col(order), F.lit(None).cast(records.schema[order].dataType))
    first = F.col(order).isNull() & F.col("__kept").isNotNull()
    return joined.withColumn("refers_to", F.when(other | first, F.col("__kept"))).drop("__kept")


# ---- writing


def _base32(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _hex(digest: str) -> str:
    value = digest.partition(":")[2]
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower()


def _safe(value: str) -> str:
    """An address without control characters, blanks and non-ASCII, percent-encoded."""
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


class RecordHead(NamedTuple):
    record_id: str | None
    uri: str | None
    refers_to: str | None
    payload_bytes: int
    payload_digest: str


def _urn(record_id: str | None) -> str:
    return f"<urn:x-record:{_safe(record_id or '')}>"


def header_bytes(h: RecordHead, date: str) -> bytes:
    """WARC header, blank line, and the HTTP header that opens the block.

    The HTTP header gives the full payload's length in a revisit too, as the
    server sent it.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {h.payload_bytes}\r\n\r\n"
    lines = [
        VERSION,
        f"WARC-Type: {'revisit' if h.refers_to is not None else 'response'}",
        f"WARC-Record-ID: {_urn(h.record_id)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_safe(h.uri)}"] if h.uri else []),
        f"WARC-Payload-Digest: {_base32(h.payload_digest)}",
        f"Content-Type: {HTTP_TYPE}",
    ]
    if h.refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(h.refers_to)}"]
    stored = 0 if h.refers_to is not None else h.payload_bytes
    lines.append(f"Content-Length: {len(http) + stored}")
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


class ArchiveWriter:
    """One file, one gzip member for each record, written as the bytes come."""

    def __init__(self, folder: str, name: str):
        self.system, base = fs.FileSystem.from_uri(folder)
        self.system.create_dir(base, recursive=True)
        self.path = f"{folder}/{name}"
        self.out, self.size, self.records = self.system.open_output_stream(f"{base}/{name}", compression=None), 0, 0

    def begin(self) -> None:
        self.gzip = zlib.compressobj(1, zlib.DEFLATED, 31)

    def add(self, data: bytes) -> None:
        self._put(self.gzip.compress(data))

    def end(self) -> None:
        self._put(self.gzip.compress(b"\r\n\r\n") + self.gzip.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.size += len(data)


def write(chunks: DataFrame, planned: DataFrame, folder: str, date: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives into ``folder``; returns the list of files (archive, records).

    ``planned``: one row for each id and payload: record_id, payload_bytes,
    payload_digest, refers_to. Every attempt of a task writes files of its
    own; only those of the attempt that Spark accepted are in the list.
    Revisits need their record's first chunk only.
    """
    listed = struct("archive string, records long")
    joined = (
        chunks.alias("c")
        .join(
            planned.alias("p"),
            F.col("c.record_id").eqNullSafe(F.col("p.record_id")) & (F.col("c.payload_digest") == F.col("p.payload_digest")),
        )
        .filter("p.refers_to is null or c.chunk_no = 0")
        .select("c.record_id", "c.uri", "p.refers_to", "p.payload_bytes", "p.payload_digest", "c.chunk_no", "c.data", "c.last", "c.row_no")
        .sortWithinPartitions("record_id", "payload_digest", "row_no", "chunk_no")
        .drop("row_no")
    )

    def run(batches):
        attempt = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        writer, done, files = None, [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                rid, uri, refers, size, digest, k, data, last = (x.as_py() for x in row)
                if k == 0:
                    if writer is None or writer.size >= archive_bytes:
                        if writer:
                            writer.out.close()
                            done.append((writer.path, writer.records))
                        writer, files = ArchiveWriter(folder, f"{attempt}-{files:04d}.warc.gz"), files + 1
                    writer.begin()
                    writer.add(header_bytes(RecordHead(rid, uri, refers, size, digest), date))
                if refers is None:
                    writer.add(data)
                if last or refers is not None:
                    writer.end()
        if writer:
            writer.out.close()
            done.append((writer.path, writer.records))
            yield pa.RecordBatch.from_pylist(
                [{"archive": a, "records": n} for a, n in done], schema=to_arrow_schema(listed)
            )

    return store(joined.mapInArrow(run, listed), "warc-list")


# ---- reading


class Unzipped:
    """Bytes of a file, gzip members unpacked, with look-ahead for header lines."""

    def __init__(self, path: str, block: int = 1 << 18):
        system, inner = fs.FileSystem.from_uri(path)
        self.file, self.block, self.held = system.open_input_stream(inner, compression=None), block, b""
        self.raw, self.at, self.zipped, self.gzip = b"", 0, None, None

    def _more(self) -> bytes:
        if not self.raw:
            self.raw = self.file.read(self.block)
            if self.zipped is None:
                self.zipped = self.raw[:2] == b"\x1f\x8b"
        if not self.raw:
            return b""
        if not self.zipped:
            data, self.raw = self.raw, b""
            return data
        if self.gzip is None or self.gzip.eof:
            self.gzip = zlib.decompressobj(31)
        data = self.gzip.decompress(self.raw, self.block * 4)
        self.raw = self.gzip.unused_data if self.gzip.eof else self.gzip.unconsumed_tail
        return data or self._more()

    def until(self, mark: bytes, limit: int = 1 << 20) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the file."""
        while (i := self.held.find(mark)) < 0:
            more = self._more()
            if not more:
                if self.held.strip():
                    raise ValueError("the archive ends within a record")
                return None
            self.held += more
            if len(self.held) > limit + 4 * self.block:
                raise ValueError("a header that does not end")
        got, self.held = self.held[: i + len(mark)], self.held[i + len(mark) :]
        self.at += len(got)
        return got

    def stream(self, n: int, size: int) -> Iterator[bytes]:
        """The next ``n`` bytes in chunks of ``size``, the last one shorter."""
        while n:
            want, parts, have = min(n, size), [], 0
            while have < want:
                if not self.held:
                    self.held = self._more()
                    if not self.held:
                        raise ValueError("the archive ends within a record")
                part, self.held = self.held[: want - have], self.held[want - have :]
                parts.append(part)
                have += len(part)
            n, self.at = n - want, self.at + want
            yield b"".join(parts)


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, s, v in (x.partition(":") for x in lines) if s}


def _unquoted(urn: str | None) -> str | None:
    m = re.fullmatch(r"<urn:x-record:(.*)>", urn or "")
    if m is None:
        return urn
    return re.sub(rb"%([0-9A-F]{2})", lambda x: bytes([int(x[1], 16)]), m[1].encode()).decode() or None


def records(path: str, chunk_bytes: int) -> Iterator[tuple]:
    """Chunk rows of one archive, as ``READ`` has them."""
    source = Unzipped(path)
    while True:
        at = source.at
        head = source.until(b"\r\n\r\n")
        if head is None:
            return
        warc = _fields(head)
        left = int(warc["content-length"])
        http = {}
        if warc.get("content-type", "").startswith("application/http") and left:
            block = source.until(b"\r\n\r\n")
            http, left = _fields(block), left - len(block)
        kind = warc["warc-type"]
        base = (
            path, at, kind, _unquoted(warc.get("warc-record-id")), warc.get("warc-target-uri"),
            _unquoted(warc.get("warc-refers-to")), int(http.get("content-length", left)),
            _hex(warc["warc-payload-digest"]) if "warc-payload-digest" in warc else None,
        )
        digest, total, k, row = Digest(), left, 0, None
        for data in source.stream(left, chunk_bytes):
            size, sha = digest.add(data)
            yield (*base, k, data, size, sha, size == total)
            k += 1
        if not total:
            yield (*base, 0, b"", *digest.add(b""), True)
        source.until(b"\r\n\r\n")


def read(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of all records in the listed archives, one file to a task at a time.

    A response whose bytes do not have the digest in its header fails the task.
    """

    def run(batches):
        def rows():
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    for row in records(path, chunk_bytes):
                        if row[-1] and row[2] == "response" and row[7] not in (None, row[-2]):
                            raise ValueError(f"{path}: record at {row[1]} has another digest")
                        yield row

        yield from _batches(rows(), READ, 9)

    files = archives.select("archive").repartition(F.col("archive"))
    return files.mapInArrow(run, READ)


def archive_pages(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page (page_id, url, html) and read all of them back.

    Returns the records as read: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest. Empty tables give no rows. Every row is a
    record of its own; rows of one id with equal payloads are records of
    the same kind. A null id counts as the smallest.
    """
    rows = pages.select("page_id", "url", "html")
    chunks = chunk_table(rows, "page_id", "url", "html")
    known = store(heads(chunks).withColumn("page_id", F.col("record_id").cast("long")), "warc-heads")
    planned = plan_revisits(known, "page_id").select(
        "record_id", "payload_bytes", "payload_digest", F.col("refers_to").cast("string").alias("refers_to")
    )
    found = read(write(chunks, planned.dropDuplicates(), folder, date)).filter("last")
    return found.select(
        F.col("record_id").cast("long").alias("page_id"),
        F.col("uri").alias("url"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
        "payload_bytes",
        F.when(F.col("record_type") == "response", F.col("sha1")).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )


def archive_folder(spark) -> str:
    folder = work_dir(spark, "warc")
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
