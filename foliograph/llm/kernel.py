"""Vectorised text kernels: words, rolling hashes and sliding minima over Arrow string buffers.

All functions work on the UTF-8 bytes of many documents at once, so that no Python object is made
for a word. A *chunk* is a run of rows whose texts hold about ``CHUNK`` bytes; one long text is
never cut. Hash arithmetic is modulo 2**64 and equal on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64


def as_array(col) -> pa.Array:
    """One contiguous string array; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.fill_null("") if col.null_count else col


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; offsets has a value more than there are rows."""
    col = as_array(col)
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    if not len(col) or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offs, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw, off


def chunks(col, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows."""
    raw, off = buffers(col)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, to, raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


@lru_cache(maxsize=16)
def byte_table(seed: int, lower: bool = False, zero: bytes = b"") -> np.ndarray:
    """A random odd value for each byte; A-Z as a-z if lower; 0 for the bytes of ``zero``."""
    t = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
    if lower:
        t[65:91] = t[97:123]
    t[list(zero)] = 0
    return t


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
WORD_BASE, GRAM_BASE, BASE_2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    had = _POWERS.get(base)
    if had is None or len(had[0]) < n:
        size = 1 << max(12, (n - 1).bit_length() if n else 0)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        had = tuple(made)
        if size <= 8 * CHUNK:
            _POWERS[base] = had
    return had[0][:n], had[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words: maximal runs of bytes with inside[byte], never across texts.

    Returns starts, ends, and for each text (and one more) the index of its first word.
    """
    isw = inside[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = isw[:-1]
    starts = np.flatnonzero(isw & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = isw[1:]
    ends = np.flatnonzero(isw & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


SPACES = bytes([9, 10, 11, 12, 13, 32])
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False


def word_hashes(data: np.ndarray, starts: np.ndarray, table: np.ndarray, base: int = WORD_BASE) -> np.ndarray:
    """A hash of each word; table must be 0 for the bytes between words."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(data))
    return mix(np.add.reduceat(table[data] * up, starts) * down[starts])


def ngrams(h: np.ndarray, k: int, base: int = GRAM_BASE) -> np.ndarray:
    """Hash of each k consecutive values; len(h) - k + 1 of them. Texts' bounds are the caller's matter."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(h) + 1)
    c = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=c[1:])
    return mix((c[k:] - c[:-k]) * down[: len(h) - k + 1])


class Ranges:
    """Hashes of any stretch of a sequence of values."""

    def __init__(self, h: np.ndarray, base: int):
        up, self.down = powers(base, len(h) + 1)
        self.c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[:-1], out=self.c[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.c[b] - self.c[a]) * self.down[a])


def sliding_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """For each stretch of w values the index of its least one, the leftmost of equals."""
    n = len(v) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    idx, val, span = np.arange(len(v), dtype=np.int32), v, 1
    while True:
        step = min(span, w - span)
        if not step:
            return idx[:n]
        right = val[step:] < val[:-step]
        idx = np.where(right, idx[step:], idx[:-step])
        val = np.where(right, val[step:], val[:-step])
        span += step


def texts_of(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text in which each position lies."""
    return np.searchsorted(off, at, "right") - 1


def unique(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending, by sorting."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]
