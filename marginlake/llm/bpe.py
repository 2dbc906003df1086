"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can end its encoding. The
table of these last tokens gives the encoding by walking back, grows by exact
appends, and needs recomputing only near an edit.

A token t ends the prefix of i bytes if it is a suffix of that prefix and the
last token of the shorter prefix may stand before it: merging their bytes by
rank leaves the two tokens as they are. Both facts are local, so no other
token of the piece matters.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginlake.llm.common import STEP, U64, by_batch, kept, mix

#: Pieces, and words, that each of the two generations of a task's caches holds.
CACHED_PIECES, CACHED_WORDS = 60_000, 100_000
#: Remembered pairs of tokens; beyond them their table starts anew.
KNOWN_PAIRS = 300_000
#: Longer pieces and words are encoded but not cached.
CACHED_CHARS = 48
#: Pieces up to so many bytes are encoded together, so many at a time.
BATCHED_BYTES, BATCHED_PIECES = 48, 50_000
#: Entries, as a power of two, of the memory of token pairs.
PAIR_BITS = 20
ABSENT = -2
MASK = (1 << 64) - 1
#: Texts of about so many characters are split and encoded together.
TOGETHER = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a rank file (base64 token, blank, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks, and which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self.known: dict[int, bool] = {}
        self.longest = max(map(len, ranks))
        # Every ending of a token -> the token that consists of it, or -1: a walk
        # to the left stops where no token goes on.
        self.endings: dict[bytes, int] = {}
        for t in ranks:
            for n in range(1, len(t)):
                self.endings.setdefault(t[-n:], -1)
        self.endings.update(ranks)

    def merge(self, data: bytes, below: int | None = None) -> list[int]:
        """Plain BPE: join the adjacent pair of lowest rank, leftmost first, while there is one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(
                ((r, i) for i in range(len(parts) - 1) if (r := self.ids.get(parts[i] + parts[i + 1])) is not None),
                default=None,
            )
            if best is None or below is not None and best[0] >= below:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ids[p] for p in parts]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for single bytes.

        A token that merging never reaches raises KeyError.
        """
        if token not in self._parts:
            data = self.tokens[token]
            if len(data) == 1:
                self._parts[token] = None
            else:
                halves = self.merge(data, below=token)
                self._parts[token] = (halves[0], halves[1]) if len(halves) == 2 else ()
        found = self._parts[token]
        if found == ():
            raise KeyError(token)
        return found

    def reachable(self, token: int) -> bool:
        try:
            self.parts(token)
        except KeyError:
            return False
        return True

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes gives back the two tokens."""
        if len(self.known) > KNOWN_PAIRS:
            self.known.clear()
        fits = self.known[left << 32 | right] = self.reachable(right) and self._boundary_holds(left, right)
        return fits

    def _boundary_holds(self, left: int, right: int) -> bool:
        """Undo merges beside the boundary, latest first; at no time may a merge across it come earlier."""
        until = None  # a merge across with a rank below this would have come first
        while True:
            across = self.ids.get(self.tokens[left] + self.tokens[right])
            if across is not None and (until is None or across < until):
                return False
            a, b = self.parts(left), self.parts(right)
            if a is None and b is None:
                return True
            # Of equal merges the leftmost comes first, so the right one is undone first.
            if b is not None and (a is None or right >= left):
                until, right = right + 1, b[0]
            else:
                until, left = left, a[1]


class PrefixTable:
    """The last token of every prefix of ``data``."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _extend(self, data: bytes, last: list[int], i: int) -> None:
        """Append the entry of the prefix of ``i`` bytes to ``last``."""
        v = self.vocabulary
        endings, known = v.endings, v.known
        found, n = [], 1
        while n <= i and (t := endings.get(data[i - n : i])) is not None:
            if t >= 0:
                found.append((n, t))
            n += 1
        for n, t in reversed(found):
            before = last[i - n]
            if before < 0:
                fits = v.reachable(t)
            elif (fits := known.get(before << 32 | t)) is None:
                fits = v.fits(before, t)
            if fits:
                last.append(t)
                return
        raise ValueError(f"no token ends at byte {i}: the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        """Lengthen the data. What stands in the table stays right."""
        start, self.data = len(self.data), self.data + more
        for i in range(start + 1, len(self.data) + 1):
            self._extend(self.data, self.last, i)

    def truncate(self, size: int) -> None:
        """Shorten the data to its first ``size`` bytes."""
        self.data = self.data[:size]
        del self.last[size + 1 :]

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes [start, end); returns how many entries were computed.

        Behind the edit, as many unchanged entries in a row as the longest
        token has bytes fix all further ones: the old table is used again.
        """
        data = self.data[:start] + new + self.data[end:]
        last, shift = self.last[: start + 1], len(new) - (end - start)
        same = 0
        for i in range(start + 1, len(data) + 1):
            self._extend(data, last, i)
            behind = i - (start + len(new))
            same = same + 1 if behind > 0 and last[i] == self.last[i - shift] else 0
            if same >= self.vocabulary.longest and behind >= self.vocabulary.longest:
                done = i - start
                last += self.last[i - shift + 1 :]
                break
        else:
            done = len(data) - start
        self.data, self.last = data, last
        return done

    def tokens(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            t = self.last[i]
            out.append(t)
            i -= len(self.vocabulary.tokens[t])
        return out[::-1]


class HashTable:
    """64-bit keys to numbers, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 6).bit_length())
        self.keys = np.zeros(1 << self.bits, U64)
        self.values = np.full(1 << self.bits, ABSENT, np.int64)
        self.probes, left = 0, np.arange(len(keys))
        while len(left):
            at = self._slot(keys[left], self.probes)
            _, first = np.unique(at, return_index=True)
            first = first[self.values[at[first]] == ABSENT]
            self.keys[at[first]], self.values[at[first]] = keys[left[first]], values[left[first]]
            left = np.delete(left, first)
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys >> U64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Their values, ABSENT for others."""
        at = self._slot(keys, 0)
        out, hit = self.values[at], self.keys[at] == keys
        left = np.flatnonzero(~hit & (out != ABSENT))
        out[~hit] = ABSENT
        for probe in range(1, self.probes):
            if not len(left):
                break
            at = self._slot(keys[left], probe)
            found, hit = self.values[at], self.keys[at] == keys[left]
            out[left[hit]] = found[hit]
            left = left[~hit & (found != ABSENT)]
        return out


class PrefixTables:
    """Prefix tables of many short pieces at once.

    Pieces are sorted; a prefix that several share is computed for the first of
    them. Entries of one length are computed together, by arrays, for all pieces.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        names = list(vocabulary.endings)
        longest = max(map(len, names))
        self.powers = np.array([pow(STEP, n, 1 << 64) for n in range(max(longest, BATCHED_BYTES) + 1)], U64)
        keys = np.array([self._key_of(t) for t in names], U64)
        self.endings = HashTable(keys, np.fromiter(vocabulary.endings.values(), np.int64, len(names)))
        self.sizes = np.zeros(max(vocabulary.tokens) + 1, np.int64)
        for i, t in vocabulary.tokens.items():
            self.sizes[i] = len(t)
        # Which pairs fit: a direct-mapped memory of the last answers.
        self.pair, self.fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def _key_of(self, data: bytes) -> int:
        h = 0
        for b in data:
            h = (h * STEP + b + 1) & MASK
        return int(mix(np.array([h ^ len(data)], U64))[0])

    def _fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        key = (before + 1) << 32 | token
        at = (mix(key.astype(U64)) >> U64(64 - PAIR_BITS)).astype(np.int64)
        new = np.flatnonzero(self.pair[at] != key)
        out = self.fits[at]
        if len(new):
            v = self.vocabulary
            found = {k: v.reachable(k & 0xFFFFFFFF) if k >> 32 == 0 else v.fits((k >> 32) - 1, k & 0xFFFFFFFF) for k in np.unique(key[new]).tolist()}
            out[new] = [found[k] for k in key[new].tolist()]
            self.pair[at[new]], self.fits[at[new]] = key[new], out[new]
        return out

    def tokens(self, pieces: list[bytes]) -> list[bytes]:
        """The token ids of each piece, as the bytes of 32-bit numbers. ``pieces`` are sorted and not empty."""
        count = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, count)
        longest = int(lengths.max())
        data = np.zeros((count, longest), np.int64)
        data[np.arange(longest) < lengths[:, None]] = np.frombuffer(b"".join(pieces), np.uint8) + np.int64(1)
        # Length of the prefix shared with the piece before; blanks behind an end are 0 and differ from any byte.
        differs = data[1:] != data[:-1]
        shared = np.concatenate([[0], np.where(differs.any(axis=1), differs.argmax(axis=1), longest)])
        rolled = np.zeros((longest + 1, count), U64)
        for i in range(longest):
            rolled[i + 1] = rolled[i] * U64(STEP) + data[:, i].astype(U64)
        last = np.full((longest + 1, count), -1, np.int64)
        everyone = np.arange(count)
        for i in range(1, longest + 1):
            own = shared < i  # the first with this prefix
            rows = np.flatnonzero(own & (lengths >= i))
            alive, n = rows, 1
            found: list[tuple[np.ndarray, np.ndarray]] = []
            while n <= i and len(alive):
                h = rolled[i, alive] - rolled[i - n, alive] * self.powers[n]
                token = self.endings.get(mix(h ^ U64(n)))
                alive, token = alive[token != ABSENT], token[token != ABSENT]
                whole = token >= 0
                found.append((alive[whole], token[whole]))
                n += 1
            row, token = (np.concatenate(x) for x in zip(*found, strict=True))
            good = self._fits(last[i - self.sizes[token], row], token)
            last[i, row[good]] = token[good]
            last[i] = last[i, np.maximum.accumulate(np.where(own, everyone, 0))]
        if (last[lengths, everyone] < 0).any():
            raise ValueError("a prefix that no token ends: the vocabulary lacks a byte")
        out, at = np.zeros((count, longest), np.int32), lengths.copy()
        fill = np.full(count, longest)
        while (left := np.flatnonzero(at)).size:
            token = last[at[left], left]
            fill[left] -= 1
            out[left, fill[left]] = token
            at[left] -= self.sizes[token]
        return [out[k, f:].tobytes() for k, f in enumerate(fill.tolist())]


class Generations(dict):
    """Text -> its token ids, as the bytes of 32-bit numbers.

    When it is full it becomes the older generation, from which what is met
    again comes back.
    """

    def __init__(self, size: int):
        super().__init__()
        self.size, self.older = size, {}

    def missing(self, texts: set[str]) -> list[str]:
        """Those that are in neither generation; those in the older one come back."""
        out = []
        for t in texts.difference(self):
            if t in self.older:
                self[t] = self.older[t]
            else:
                out.append(t)
        return out

    def forget(self) -> None:
        """Called between texts: start a generation if this one is full."""
        if len(self) >= self.size:
            self.older = {k: v for k, v in self.items() if len(k) <= CACHED_CHARS}
            self.clear()


def piece_pattern(pattern: str) -> regex.Pattern:
    """The split pattern for the regex module; blanks are those with the White_Space property."""
    return regex.compile(pattern.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), regex.V0)


#: White space other than blank and line feed.
OTHER_SPACE = re.compile(r"[^\S \n]")


class TextEncoder:
    """Token ids of whole texts; every match of the pattern is encoded by itself.

    A blank between two characters that are no white space always begins a
    match, whatever stands around. So a text in which blanks are single and not
    beside other white space is encoded by its words, each with the blank before
    it, and words repeat more than they differ. Other texts go match by match.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.tables = PrefixTables(self.vocabulary)
        self.pattern = piece_pattern(pattern)
        self.pieces, self.words = Generations(CACHED_PIECES), Generations(CACHED_WORDS)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for some in together(texts):
            out += self._encode_group([t or "" for t in some])
            self.pieces.forget()
            self.words.forget()
        return out

    def _encode_group(self, texts: list[str]) -> list[np.ndarray]:
        split = self.pattern.findall
        heads, tails = [], []  # matches of the beginning, and words behind it
        for t in texts:
            words = t.split(" ")
            if "" in words or " \n" in t or "\n " in t or OTHER_SPACE.search(t):
                heads.append(split(t))
                tails.append([])
            else:
                heads.append(split(words[0]))
                tails.append(words[1:])
        new = {w: split(" " + w) for w in self.words.missing(set().union(*tails))}
        self._learn(set().union(*heads, *new.values()))
        piece, word = self.pieces.__getitem__, self.words.__getitem__
        for w, parts in new.items():
            self.words[w] = b"".join(map(piece, parts))
        return [
            np.frombuffer(b"".join(map(piece, h)) + b"".join(map(word, t)), dtype=np.int32)
            for h, t in zip(heads, tails, strict=True)
        ]

    def _learn(self, pieces: set[str]) -> None:
        """Encode new pieces, sorted by their bytes, many at a time; long ones by themselves."""
        short, ids = [], self.vocabulary.ids
        for piece in self.pieces.missing(pieces):
            data = piece.encode("utf-8", "surrogatepass")
            whole = ids.get(data)
            if whole is not None:
                self.pieces[piece] = array("i", [whole]).tobytes()
            elif len(data) > BATCHED_BYTES:
                self.pieces[piece] = array("i", PrefixTable(self.vocabulary, data).tokens()).tobytes()
            else:
                short.append((data, piece))
        short.sort()
        for i in range(0, len(short), BATCHED_PIECES):
            some = short[i : i + BATCHED_PIECES]
            for (_, piece), found in zip(some, self.tables.tokens([d for d, _ in some]), strict=True):
                self.pieces[piece] = found


def together(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts in groups of some million characters."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    decoded: str | None = None,
    exact: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``ids``, the array of token ids of each whole text.

    Null and empty texts have no ids. A column already called ``ids`` is
    replaced. With ``decoded``, a column of that name gets the bytes that the ids
    stand for, in the same pass; with ``exact``, one that says whether these are the text's. Of ``docs``
    the result has the columns ``keep`` (default: all). The rank file is read once by the driver and
    sent to all tasks; its size bounds the broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    key = f"{ranks_path}\n{pattern}"

    def make():
        encoder = kept("bpe", key, lambda: TextEncoder(sent.value, pattern))
        tokens = kept("bpe", ranks_path, lambda: token_bytes(sent.value)) if decoded or exact else None

        def step(cols):
            rows = encoder.encode_all(cols[read].to_pylist())
            ends = np.cumsum([0, *map(len, rows)])
            flat = np.concatenate(rows)
            out = {ids: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))}
            if tokens:
                data = _decoded(flat, ends, tokens)
                out |= {decoded: data} if decoded else {}
                out |= {exact: pa.compute.equal(data, pa.compute.fill_null(cols[read].cast(pa.binary()), b""))} if exact else {}
            return cols | out

        return step

    keep = [c for c in (docs.columns if keep is None else keep) if c not in (ids, decoded, exact)]
    # A text that is kept is sent once.
    there = text in keep and dict(docs.dtypes)[text] == "string"
    read = text if there else "__text"
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if there else [F.col(f"`{text}`").cast("string").alias(read)]))
    more = [(ids, "ints"), *([(decoded, "binary")] if decoded else []), *([(exact, "boolean")] if exact else [])]
    return by_batch(rows, make, _ddl(docs, keep) + more, "bpe")


def _decoded(flat: np.ndarray, ends: np.ndarray, tokens: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
    """The bytes of each list of ids; ``ends`` are the bounds of the lists."""
    blob, begins, sizes = tokens
    if len(flat) and not (0 <= flat.min() and flat.max() < len(sizes) and (sizes[flat] > 0).all()):
        raise KeyError("an id outside the vocabulary")
    n = sizes[flat]
    upto = np.cumsum(n)
    at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(begins[flat] - (upto - n), n)
    cuts = np.concatenate([[0], upto])[ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(blob[at].tobytes())])


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes one behind the other, and where each id's begin and how many they are."""
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for t, i in ranks.items():
        sizes[i] = len(t)
    begins = np.cumsum(sizes) - sizes
    by_id = sorted((i, t) for t, i in ranks.items())
    return np.frombuffer(b"".join(t for _, t in by_id), np.uint8), begins, sizes


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Add ``data``, the bytes that the ids stand for. No ids, or null, give no bytes.

    An id outside the vocabulary fails the task.
    """
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        tokens = kept("bpe", ranks_path, lambda: token_bytes(sent.value))

        def step(cols):
            lists = cols[ids]
            ends = np.cumsum([0, *(x or 0 for x in pa.compute.list_value_length(lists).to_pylist())])
            return cols | {data: _decoded(lists.flatten().to_numpy(zero_copy_only=False), ends, tokens)}

        return step

    keep = [c for c in df.columns if c != data]
    return by_batch(df.select(*[F.col(f"`{c}`") for c in keep]), make, _ddl(df, keep) + [(data, "binary")], "bpe")


def _ddl(df: DataFrame, keep: list[str]) -> list[tuple[str, object]]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [(c, kinds[c]) for c in keep]
