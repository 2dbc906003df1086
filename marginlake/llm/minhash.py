"""One-permutation MinHash with optimal densification.

Each shingle is hashed once; the leading bits choose a bin, the rest compete to
be the bin's least value. A bin that got nothing copies the bin that a fixed
sequence of random choices hits first, so that two sets agree in any bin with
the probability of their Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

from marginlake.llm.common import U64, hashes, mix, windows

SHINGLE_WORDS = 5
EMPTY = np.uint32(0xFFFFFFFF)
_CHOICE = U64(0xD6E8FEB86659FD93)


def shingles(text: str | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct shingle hashes, ascending: A-Z lower-cased, ``k`` words each.

    Fewer words than ``k`` are one shingle, no words none.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower() knows A-Z only
    if not tokens:
        return np.empty(0, U64)
    h = hashes(tokens)
    return np.unique(windows(h, min(k, len(h))))


def signatures(sets: list[np.ndarray], bins: int, seed: int = 0) -> np.ndarray:
    """A row of ``bins`` 32-bit values for each set; empty sets have EMPTY everywhere."""
    out = np.full((len(sets), bins), EMPTY, np.uint32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if not sizes.sum():
        return out
    h = mix(np.concatenate(sets) ^ U64(seed))
    row = np.repeat(np.arange(len(sets)), sizes)
    bin_of = ((h >> U64(32)) * U64(bins)) >> U64(32)
    np.minimum.at(out.reshape(-1), row * bins + bin_of.astype(np.int64), (h & U64(0xFFFFFFFE)).astype(np.uint32))
    full = out != EMPTY
    rows, cols = np.nonzero(~full & (sizes > 0)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        choice = mix(cols.astype(U64) * _CHOICE + U64(attempt))
        donor = (((choice >> U64(32)) * U64(bins)) >> U64(32)).astype(np.int64)
        hit = full[rows, donor]
        out[rows[hit], cols[hit]] = out[rows[hit], donor[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return out


def low_bits(signature: np.ndarray, bits: int) -> np.ndarray:
    """The packed ``bits`` low-order bits of every bin, a row of bytes for each set.

    Values are remixed with the bin's number first: least values are not uniform
    in their low bits, and copies of one value must not agree by chance together.
    """
    salt = np.arange(signature.shape[1], dtype=U64) << U64(32)
    low = (mix(signature.astype(U64) | salt) & U64((1 << bits) - 1)).astype(np.uint8)
    planes = (low[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(planes.reshape(len(signature), -1), axis=1)


def likeness(a: np.ndarray, b: np.ndarray, bins: int, bits: int) -> np.ndarray:
    """Estimated Jaccard similarity of packed rows: agreement less what chance gives."""
    same = ~np.unpackbits(a ^ b, axis=1).reshape(len(a), bins, bits).any(axis=2)
    chance = 0.5**bits
    return np.clip((same.mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A bucket key for every ``rows`` consecutive bins, different for each band."""
    count = signature.shape[1] // rows
    cut = signature[:, : count * rows].astype(U64).reshape(len(signature), count, rows)
    key = np.broadcast_to(np.arange(1, count + 1, dtype=U64) * _CHOICE, cut.shape[:2]).copy()
    for j in range(rows):
        key = mix(key ^ cut[:, :, j]) + U64(j)
    return key
