"""Words and substring hashes of many texts at once, in numpy over Arrow's own buffers.

Arrow keeps the UTF-8 bytes of a string column end to end, so a batch of texts is one byte
array with offsets. Every function here works on such blocks, cut at a quarter of a megabyte of
whole texts to stay in the processor's caches; a longer text is a block of its own, or, where an
operator needs no more than windows of bounded length, comes in overlapping parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
#: Powers are tabulated for so many places; longer data start them anew.
TILE = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets into them) of a column of texts or bytes; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows; nulls count as empty."""
    raw, offsets = flat(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def parts(column: pa.Array, overlap: int, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Blocks as above, but a text longer than ``size`` comes in parts of that size, of which neighbours have
    ``overlap`` bytes in common; the last value is where in its text the part begins."""
    for lo, hi, data, offsets in blocks(column, size):
        if len(data) <= size:
            yield lo, hi, data, offsets, 0
            continue
        for at in range(0, max(1, len(data) - overlap), size - overlap):
            part = data[at : at + size]
            yield lo, hi, part, np.array([0, len(part)]), at


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


@cache
def _powers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64, up to TILE."""
    base = (_MULTIPLIER * (2 * seed + 1)) % 2**64
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(TILE + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@cache
def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER) + np.uint64(seed))


class Hasher:
    """Hashes of any substrings of a block: equal bytes give equal hashes, wherever they stand."""

    def __init__(self, data: np.ndarray, seed: int = 0, table: np.ndarray | None = None):
        self.up, self.down = _powers(seed)
        values = _byte_values(seed)
        if table is not None:
            values = values[table]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        for at in range(0, len(data), TILE):  # powers start anew in every tile
            own = data[at : at + TILE]
            np.multiply(values[own], self.up[: len(own)], out=self.sums[at + 1 : at + len(own) + 1])
        np.cumsum(self.sums, out=self.sums)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.sums) - 1 <= TILE:
            return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        place = starts % TILE
        edge = starts - place + TILE
        total = (self.sums[np.minimum(ends, edge)] - self.sums[starts]) * self.down[place]
        far = np.flatnonzero(ends > edge)
        at, factor = edge[far], self.up[TILE - place[far]]
        while len(far):  # what lies in the next tile goes on with the power that the first byte has there
            stop = np.minimum(ends[far], at + TILE)
            total[far] += (self.sums[stop] - self.sums[at]) * factor
            on = ends[far] > stop
            far, at, factor = far[on], stop[on], factor[on] * self.up[TILE]
        return mix(total + (ends - starts).astype(np.uint64))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of words: all but ASCII white space; ASCII letters, digits and all beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x41:0x5B] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True


class Words:
    """The words of a block: byte starts and ends, hashes of the lower-cased (A-Z) bytes, and each text's range."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE):
        inside = kind[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | cut[:-1]))
        self.ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.hasher = Hasher(data, table=LOWER)
        self.hashes = self.hasher(self.starts, self.ends)
        #: Words of text i: bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, offsets)

    def grams(self, n: int) -> np.ndarray:
        """At every word the hash of it and the n - 1 next words; right only where those are in the same text."""
        out = np.zeros(len(self.hashes), np.uint64)
        k = len(self.hashes) - n + 1
        if k > 0:
            out[:k] = gram_hashes(self.hashes, n)
        return out


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes."""
    k = len(hashes) - n + 1
    total = np.full(k, n, np.uint64)
    for i in range(n):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += hashes[i : i + k]
    return mix(total)


def word_hash(word: bytes) -> np.uint64:
    """The hash that Words gives this word."""
    data = np.frombuffer(word, np.uint8)
    return Hasher(data, table=LOWER)(np.array([0]), np.array([len(data)]))[0]
