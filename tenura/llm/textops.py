"""Vectorised text helpers used inside Spark tasks (numpy over Arrow string buffers).

A task never builds a Python object per word or byte: the string column's own
buffer is cut into chunks of whole documents and tokens, token hashes, rolling
hashes and window minima are array operations over a chunk.  Memory per task is
bounded by the chunk size, or by the longest single document where that is larger.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_R = np.uint64(0x9E3779B97F4A7C15)                     # odd, so it has an inverse mod 2**64
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

# ASCII blanks of the word pattern [^\x20\x09-\x0D]+
_BLANKS = b" \t\n\x0b\x0c\r"


def blank_separated() -> np.ndarray:
    """Byte table: True where a byte belongs to a word of ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, dtype=bool)
    t[list(_BLANKS)] = False
    return t


def byte_values(lower: bool = False) -> np.ndarray:
    """A fixed random 64-bit value per byte; with ``lower``, A-Z share those of a-z."""
    v = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
    if lower:
        v[65:91] = v[97:123]
    return v


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads a polynomial hash over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """R**i and R**-i mod 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = np.full(n, _R), np.full(n, _R_INV)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[i:j] * R**position."""
    s = np.zeros(len(values) + 1, dtype=np.uint64)
    if len(values):
        np.cumsum(values * powers.upto(len(values))[0], dtype=np.uint64, out=s[1:])
    return s


def span_hashes(s: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Position-independent hash of values[start:end] for arrays of spans."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    down = powers.upto(len(s))[1]
    return mix((s[end] - s[start]) * down[start] + (end - start).astype(np.uint64))


P61 = np.uint64((1 << 61) - 1)
_LOW31, _LOW30, _LOW32 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64((1 << 32) - 1)
_BASE = 0x1B873593CC9E2D51 % ((1 << 61) - 1)
_BASE_INV = pow(_BASE, -1, (1 << 61) - 1)


def fold(x: np.ndarray) -> np.ndarray:
    """x mod 2**61 - 1 for any 64-bit x."""
    x = (x & P61) + (x >> np.uint64(61))
    return np.where(x >= P61, x - P61, x)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x * y mod 2**61 - 1 for x, y below it."""
    xh, xl, yh, yl = x >> np.uint64(31), x & _LOW31, y >> np.uint64(31), y & _LOW31
    mid = xh * yl + xl * yh
    return fold(np.uint64(2) * xh * yh + (mid >> np.uint64(30)) + ((mid & _LOW30) << np.uint64(31)) + fold(xl * yl))


class Spans:
    """Hashes of spans of units, polynomial modulo the prime 2**61 - 1 (modulo 2**64, a pattern and its
    mirror of 1,024 letters built by doubling have one hash whatever the letters' values).

    Powers of the base are grown on demand and shared by the chunks of a task."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _upto(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, times(self.up, np.uint64(pow(_BASE, k, int(P61))))))
            self.down = np.concatenate((self.down, times(self.down, np.uint64(pow(_BASE_INV, k, int(P61))))))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """S with S[j] - S[i] = sum of values[i:j] * base**position."""
        n = len(values)
        self._upto(n + 1)
        s = np.zeros(n + 1, dtype=np.uint64)
        x = times(fold(values), self.up[:n])
        high = np.cumsum(x >> np.uint64(32), dtype=np.uint64)        # below 2**63 for 2**31 units
        low = np.cumsum(x & _LOW32, dtype=np.uint64)
        s[1:] = fold(fold(low) + (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)))
        return s

    def hashes(self, s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end], the same wherever the span stands."""
        if not len(start):
            return np.zeros(0, dtype=np.uint64)
        self._upto(len(s))
        return mix(times(fold(s[end] + P61 - s[start]), self.down[start]) + (end - start).astype(np.uint64) * _R)


def joined_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words of a chunk, each with one blank behind it, and where each word begins in that."""
    size = ends - starts
    at = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(int(at[-1]), 32, dtype=np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = buf[inside[buf]] if len(buf) else buf
    return out.tobytes(), at


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into runs of whole rows of about ``limit`` bytes.

    Yields (first row, end row, bytes of the run, offsets of its rows in it);
    a null is an empty text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield at, end, buf[off[at]:off[end]], off[at:end + 1] - off[at]
        at = end


def give_back() -> None:
    """Memory that earlier tasks of this worker freed goes back to the system: a worker is kept for
    later stages, and what a released model leaves in pieces would count beside their own.  The same
    holds for the driver, when a model that it collected has been broadcast."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):                  # not glibc
        pass


def word_spans(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a chunk, and the first word of each row (rows + 1)."""
    if not len(buf):
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(off), dtype=np.int64)
    inside = is_word[buf]
    cut = off[:-1][off[:-1] < off[1:]]                 # where non-empty rows begin
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[cut] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cut[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def window_anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` consecutive grams the index of its minimum (the rightmost of equals).

    The choice depends on the grams of the run only, so equal runs choose equal places.
    """
    n = len(grams)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    bits = np.uint64(34)                               # room for the place below the hash
    low = np.uint64((1 << int(bits)) - 1)
    key = (grams >> bits << bits) | (low - np.arange(n, dtype=np.uint64))
    step = 1
    while step * 2 <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < width:
        key = np.minimum(key[:n - width + 1], key[width - step:width - step + n - width + 1])
    return (low - (key & low)).astype(np.int64)


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start+1, ... of the given counts."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return shift + np.arange(total)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Boolean mask over range(n): inside any [start, start + length)."""
    d = np.zeros(n + 1, dtype=np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + lengths, -1)
    return np.cumsum(d[:-1]) > 0
