"""Exact removal of repeated word windows, with a count-min prefilter.

A window is 13 consecutive words. Most windows of a corpus occur once, and
grouping all of them would move many times the text. So a first pass counts
windows in a count-min sketch, which never counts too few; a second pass groups
exactly those whose estimate is two or more. A window that the sketch rules out
occurs in one place, so none is lost.

Both passes work on chunks: the documents of a task up to some millions of
words. Copies within a chunk are settled there; only one occurrence of a window
leaves a chunk, so that the most frequent passage of the corpus is as many rows
as there are chunks. What crosses the network is packed arrays: about 9 bytes for
a window that is grouped, 4 for one that is to be removed, and compressed texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marginlake.llm.common import (
    SLICE_BYTES,
    U64,
    _fields,
    give_back,
    hashes,
    mix,
    release,
    slices,
    struct,
    windows,
    words,
)

WINDOW = 13
#: Words that a chunk holds; a longer document is a chunk of its own.
CHUNK_WORDS = 1_200_000
#: Rows of the sketch, each with its own hash.
ROWS = 2
#: Cells of a sketch row: the power of two from a quarter of the corpus's bytes,
#: within these bounds. The merged sketch is one bit to a cell ("two or more"),
#: so its broadcast is at most ROWS * 2**MOST_BITS / 8 bytes: 128 MB. A corpus of
#: more windows than cells is treated the same way; more windows then pass the
#: prefilter, and the exact pass settles them.
LEAST_BITS, MOST_BITS = 20, 29
#: Each sketch row is merged in so many pieces.
SEGMENT_BITS = 7
#: Queries are grouped in at least so many ranges of window hashes, and in more
#: where ranges would hold over RANGE_WINDOWS windows. Answers are grouped in as
#: many ranges of document hashes.
LEAST_RANGES, RANGE_WINDOWS = 256, 1 << 22

NO_ID = -(1 << 63)
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def _keyed(docs: DataFrame, tagged: bool, *more: str) -> DataFrame:
    """key (doc_id; null is smaller than all), tag (tells apart texts of one id; 0 unless ``tagged``), text."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"),
        (F.hash("text") if tagged else F.lit(0)).alias("tag"),
        F.col("text").cast("string").alias("text"),
        *more,
    )


class Chunk:
    """Word hashes of some documents, and from them all windows."""

    def __init__(self):
        self.keys, self.tags, self.parts, self.words = [], [], [], 0

    def add(self, key: int, tag: int, text: str | None) -> None:
        h = hashes(words(text))
        if len(h) >= WINDOW:
            self.keys.append(key)
            self.tags.append(tag)
            self.parts.append(h)
            self.words += len(h)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document (number within the chunk) and first word of every window."""
        sizes = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        begins = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        w = windows(np.concatenate(self.parts), WINDOW)
        inside = doc[: len(w)] == doc[WINDOW - 1 :]
        doc = doc[: len(w)][inside]
        return w[inside], doc, (np.flatnonzero(inside) - begins[doc]).astype(np.int32)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    release()
    chunk = Chunk()
    for batch in batches:
        for key, tag, text in zip(*batch.columns, strict=True):
            chunk.add(key.as_py(), tag.as_py(), text.as_py())
            if chunk.words >= CHUNK_WORDS:
                yield chunk
                chunk = Chunk()
    if chunk.words:
        yield chunk
    chunk = None
    give_back()


def cells(window: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each window in a sketch row."""
    h = window if row == 0 else mix(window ^ U64(0xA5A5A5A5 * row))
    return h >> U64(64 - bits)


# Numbers as planes of their bytes, each plane by itself in zstd if that is shorter: high bytes mostly vanish.


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers from 0 to 2**64 - 1, packed."""
    n = len(numbers)
    wide = (int(numbers.max()).bit_length() + 7) // 8 if n else 0
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(n, 8)[:, :wide].T)
    out = [n.to_bytes(4, "little")]
    for plane in planes:
        raw = plane.tobytes()
        short = pa.compress(raw, codec="zstd", asbytes=True)
        best = min(raw, short, key=len)  # the raw one if they are as long
        out += [len(best).to_bytes(4, "little"), best]
    return b"".join(out)


def unsqueeze(data: bytes) -> np.ndarray:
    n, at, planes = int.from_bytes(data[:4], "little"), 4, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        plane = data[at + 4 : at + 4 + size]
        planes.append(plane if size == n else pa.decompress(plane, n, codec="zstd", asbytes=True))
        at += 4 + size
    out = np.zeros((n, 8), np.uint8)
    for i, plane in enumerate(planes):
        out[:, i] = np.frombuffer(plane, np.uint8)
    return out.view("<u8").reshape(n).astype(U64)


def pack(numbers: np.ndarray) -> bytes:
    """Ascending numbers, packed by their gaps."""
    return squeeze(np.diff(numbers, prepend=numbers.dtype.type(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data), dtype=U64)


def runs(positions: np.ndarray) -> bytes:
    """Ascending 32-bit numbers by their runs: the first, and behind it the complement of the last if that is another."""
    first = np.flatnonzero(np.diff(positions, prepend=-2) > 1)
    last = np.append(first[1:], len(positions)) - 1
    out = np.stack([positions[first], ~positions[last]], axis=1)
    keep = np.ones(out.shape, bool)
    keep[:, 1] = positions[first] != positions[last]
    return out[keep].astype(np.int32).tobytes()


def run_ends(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First and last number of every run."""
    a = np.concatenate([np.frombuffer(p, np.int32) for p in packed])
    at = np.flatnonzero(a >= 0)
    after = np.append(a, 0)[at + 1]
    return a[at], np.where(after < 0, ~after, a[at])


def sketch_bits(text_bytes: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, text_bytes) / 4))))


def sketch(docs: DataFrame, bits: int) -> list[bytes]:
    """The merged sketch: for each row, a bit for every cell that counted two or more.

    Each chunk counts every distinct window once. Partial sketches go as lists
    of counted cells, cut into segments; one segment is merged by one task.
    """
    part = struct("row int, segment int, cells binary")
    below = bits - SEGMENT_BITS

    def partial(batches):
        for chunk in _chunks(batches):
            once = np.sort(chunk.windows()[0])  # np.unique hashes, which took a hundred times as long
            once = once[np.diff(once, prepend=~once[:1]) != 0]
            for row in range(ROWS):
                at = cells(once, row, bits)
                if row:
                    at.sort()
                cut = np.searchsorted(at, np.arange((1 << SEGMENT_BITS) + 1, dtype=U64) << U64(below))
                out = [
                    (row, s, pack(at[a:b] - (U64(s) << U64(below))))
                    for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))
                    if b > a
                ]
                yield _batch(out, part)

    merged = struct("row int, segment int, twice binary")

    def merge(batches):
        held, counts = None, None

        def done():
            return _batch([(*held, np.packbits(counts >= 2).tobytes())], merged)

        for batch in batches:
            for row, segment, data in zip(*batch.columns, strict=True):
                at = (row.as_py(), segment.as_py())
                if at != held:
                    if held:
                        yield done()
                    held, counts = at, np.zeros(1 << below, np.uint8)
                found, n = np.unique(unpack(data.as_py()).astype(np.int64), return_counts=True)
                counts[found] = np.minimum(counts[found] + np.minimum(n, 2), 2)
        if held:
            yield done()

    lists = _keyed(docs, False).mapInArrow(partial, part).repartition("row", "segment").sortWithinPartitions("row", "segment")
    size = (1 << below) // 8
    rows = [bytearray(1 << (bits - 3)) for _ in range(ROWS)]
    for r in lists.mapInArrow(merge, merged).toLocalIterator():  # bounded: the cells of the sketch
        rows[r["row"]][r["segment"] * size : (r["segment"] + 1) * size] = r["twice"]
    return [bytes(r) for r in rows]


def maybe_repeated(window: np.ndarray, rows: list[np.ndarray], bits: int) -> np.ndarray:
    """Whether the sketch estimates two or more."""
    out = np.ones(len(window), bool)
    for row, twice in enumerate(rows):
        at = cells(window, row, bits).astype(np.int64)
        out &= (twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def _batch(rows: list[tuple], schema) -> pa.RecordBatch:
    target = to_arrow_schema(schema)
    columns = zip(*rows, strict=True) if rows else [[] for _ in target]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)


#: Either some windows of a chunk (range; hashes; of each the key, counted from
#: ``key``, tag and position), or, under a negative range, the runs of positions
#: of a document's windows that its chunk settled. The same without hashes:
#: windows to be removed, by a range of document hashes.
_ASKED = "range int, hash binary, keys binary, tags binary, positions binary, key long, tag int"
_FOUND = "range int, keys binary, tags binary, positions binary, key long, tag int"
_COVERED = "key long, tag int, positions binary"


def _share(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range, of so many, of each 64-bit hash."""
    return ((h >> U64(32)) * U64(ranges)) >> U64(32)


def _cuts(place: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """Number, begin and end of each range that ascending ``place`` has."""
    cut = np.searchsorted(place, np.arange(ranges + 1, dtype=U64))
    for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if b > a:
            yield r, a, b


def _pack_places(keys: np.ndarray, tags: np.ndarray, pos: np.ndarray, close=squeeze) -> tuple:
    """keys, tags, positions, key. ``close``: ``pack`` if keys ascend."""
    least = keys.min()
    return close(keys.view(U64) - least.view(U64)), squeeze(tags.view(np.uint32)), squeeze(pos), int(least)


def _unpack_places(rows: list[tuple], opened=unsqueeze) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = [(opened(keys) + np.int64(key).view(U64)).view(np.int64) for keys, _, _, key in rows]
    tags = [unsqueeze(tags).astype(np.uint32).view(np.int32) for _, tags, _, _ in rows]
    return np.concatenate(keys), np.concatenate(tags), np.concatenate([unsqueeze(p).astype(np.int32) for _, _, p, _ in rows])


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each range, which ascends; those under negative ranges as they come, under -1, with their range."""
    held, rows = None, []
    for batch in batches:
        settled = []
        for r, *row in zip(*batch.columns, strict=True):
            r = r.as_py()
            if r < 0:
                settled.append((r, *(x.as_py() for x in row)))
                continue
            if r != held:
                if rows:
                    yield held, rows
                held, rows = r, []
            rows.append(tuple(x.as_py() for x in row))
        if settled:
            yield -1, settled
    if rows:
        yield held, rows


def _per_document(keys: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Key, tag and runs of positions of each document."""
    order = np.lexsort((pos, tags, keys))
    keys, tags, pos = keys[order], tags[order], pos[order]
    new = (np.diff(keys) != 0) | (np.diff(tags) != 0)
    cut = np.concatenate([[0], np.flatnonzero(new) + 1, [len(keys)]]) if len(keys) else np.empty(0, np.int64)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(keys[a]), int(tags[a]), runs(pos[a:b])


def asked(keyed: DataFrame, sent, bits: int, ranges: int) -> DataFrame:
    """What chunks settle, and their other windows that the sketch (a broadcast) lets through, as ``_ASKED``."""
    schema = struct(_ASKED)

    def ask(batches):
        rows = [np.frombuffer(r, np.uint8) for r in sent.value]
        for chunk in _chunks(batches):
            w, doc, pos = chunk.windows()
            keys = np.array(chunk.keys, np.int64)
            tags = np.array(chunk.tags, np.int32)
            rank = np.unique(keys, return_inverse=True)[1].astype(np.int32)
            order = np.lexsort((rank[doc], w))
            w, doc, pos = w[order], doc[order], pos[order]
            new = np.diff(w, prepend=~w[:1]) != 0
            least = rank[doc[new]][np.cumsum(new) - 1]
            later = rank[doc] > least
            settled = [
                (-1 - i % ranges, None, None, None, p, key, tag)
                for i, (key, tag, p) in enumerate(_per_document(keys[doc[later]], tags[doc[later]], pos[later]))
            ]
            for i in range(0, len(settled), 5000):
                yield _batch(settled[i : i + 5000], schema)
            w, doc, pos = w[~later], doc[~later], pos[~later]
            open_ = maybe_repeated(w, rows, bits)
            w, doc, pos = w[open_], doc[open_], pos[open_]
            out = [
                (r, pack(w[a:b]), *_pack_places(keys[doc[a:b]], tags[doc[a:b]], pos[a:b]), None)
                for r, a, b in _cuts(_share(w, ranges), ranges)
            ]
            for i in range(0, len(out), 256):
                yield _batch(out[i : i + 256], schema)

    return keyed.mapInArrow(ask, schema)


def answered(questions: DataFrame, ranges: int) -> DataFrame:
    """Windows to be removed, as ``_FOUND``."""
    schema = struct(_FOUND)

    def resolve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        w = np.concatenate([unpack(row[0]) for row in rows])
        keys, tags, pos = _unpack_places([row[1:5] for row in rows])
        order = np.lexsort((keys, w))
        w, keys, tags, pos = w[order], keys[order], tags[order], pos[order]
        new = np.diff(w, prepend=~w[:1]) != 0
        later = keys > keys[new][np.cumsum(new) - 1]
        keys, tags, pos = keys[later], tags[later], pos[later]
        place = _share(mix(keys.view(U64) ^ mix(tags.astype(U64))), ranges)
        order = np.lexsort((pos, keys, place))
        keys, tags, pos, place = keys[order], tags[order], pos[order], place[order]
        out = [(r, *_pack_places(keys[a:b], tags[a:b], pos[a:b], pack), None) for r, a, b in _cuts(place, ranges)]
        for i in range(0, len(out), 256):
            yield _batch(out[i : i + 256], schema)

    def answer(batches):
        for r, rows in _by_range(batches):
            if r < 0:
                yield _batch([(row[0], *row[2:]) for row in rows], schema)
            else:
                yield from resolve(rows)

    return questions.repartition("range").sortWithinPartitions("range").mapInArrow(answer, schema)


def gathered(answers: DataFrame) -> DataFrame:
    """The windows of answers by document, as ``_COVERED``."""
    schema = struct(_COVERED)

    def gather(batches):
        for r, rows in _by_range(batches):
            if r < 0:
                yield _batch([(key, tag, p) for _, _, _, p, key, tag in rows], schema)
                continue
            out = list(_per_document(*_unpack_places([row[:4] for row in rows], unpack)))
            for i in range(0, len(out), 5000):
                yield _batch(out[i : i + 5000], schema)

    return answers.repartition("range").sortWithinPartitions("range").mapInArrow(gather, schema)


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, bool]:
    """key, tag, positions (``runs`` of first words) of all windows to be removed; several rows for a document.

    A window is removed if its word sequence also starts in a document of a
    smaller doc_id. Also returned: whether ids repeat, so that keys need tags.
    """
    ids = _keyed(docs, False).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    most, text_bytes = ids.agg(F.max("n"), F.sum("size")).first()
    tagged, text_bytes = (most or 0) > 1, text_bytes or 0
    bits = sketch_bits(text_bytes)
    ranges = max(LEAST_RANGES, text_bytes // 4 // RANGE_WINDOWS)
    sent = docs.sparkSession.sparkContext.broadcast(sketch(docs, bits))
    return gathered(answered(asked(_keyed(docs, tagged), sent, bits, ranges), ranges)), tagged


def cut(text: str, positions: list[bytes]) -> tuple[str, int, int]:
    """The text without the words of the windows at the positions (``runs``); words before, words removed.

    A removed word goes with the white space behind it.
    """
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.start() for m in WORD_BYTES.finditer(data)]
    n = len(spans)
    first, last = run_ends(positions)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + WINDOW, -1)
    gone = np.cumsum(edge)[:n] > 0
    bounds = np.array([*spans, len(data)])
    turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    out, at = [], 0
    for a, b in zip(turns[::2], turns[1::2], strict=True):
        out.append(data[at : bounds[a]])
        at = bounds[b]
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass"), n, int(gone.sum())


def shorten(text: pa.Array) -> pa.Array:
    """Texts as their size and zstd; null stays null."""
    out = []
    for x in text.cast(pa.binary()):
        data = x.as_buffer()
        out.append(None if data is None else data.size.to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True))
    return pa.array(out, pa.binary())


def lengthen(data: bytes | None) -> str | None:
    if data is None:
        return None
    size = int.from_bytes(data[:4], "little")
    return pa.decompress(data[4:], size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass") if size else ""


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated windows cut out of ``text``, and with n_words and n_removed (both of the input).

    A word is removed if a window that covers it also starts in a document of
    a smaller doc_id; windows are those of the input. Texts without removed
    words stay as they are, null stays null. A null id counts as smaller than
    all others. Rows of one id do not remove each other's words; each loses
    its own. An empty table gives no rows. Columns n_words and n_removed are
    replaced.
    """
    keep = [f.name for f in docs.schema.fields if f.name not in ("n_words", "n_removed")]
    rest = [c for c in keep if c != "text"]
    gone, tagged = repeated_windows(docs)
    found = gone.groupBy("key", "tag").agg(F.collect_list("positions").alias("hits"))
    rows = _keyed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")), tagged, "rest")
    # Texts cross the network compressed: they are the most of what the join moves.
    rows = rows.withColumn("text", F.arrow_udf(shorten, "binary")("text"))
    joined = rows.join(found, ["key", "tag"], "left").select("rest", "text", "hits")
    schema = _fields([("rest", joined.schema["rest"].dataType), ("text", "string"), ("n_words", "long"), ("n_removed", "long")])
    target = to_arrow_schema(schema)

    def step(batches):
        release()
        for part in slices(batches):
            out, size, at = [], 0, 0
            for i, (data, hits) in enumerate(zip(part["text"], part["hits"], strict=True)):
                text, hits = lengthen(data.as_py()), hits.as_py()
                out.append(cut(text, hits) if hits else (text, len(words(text)), 0))
                size += len(text or "")
                if size >= SLICE_BYTES or i + 1 == part.num_rows:
                    columns = [part["rest"].slice(at, len(out))]
                    columns += [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(target)[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=target)
                    out, size, at = [], 0, i + 1

    out = joined.mapInArrow(step, schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in keep], "n_words", "n_removed")
