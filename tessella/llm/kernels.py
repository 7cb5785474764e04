"""Vectorised text kernels: numpy over the byte buffers of Arrow columns.

A *slice* is a run of whole texts of one Arrow batch, cut so that it holds
about ``SLICE_BYTES`` (a longer text is a slice by itself), which bounds the
memory of a Python worker whatever the batch size is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

IS_SEP = np.zeros(256, bool)
IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C13  # odd and 3 mod 4
_GRAM = 0xC2B2AE3D27D4EB4F


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (in a new array)."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.n = base, 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            self.up, self.down = (self._run(b) for b in (self.base, pow(self.base, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    def _run(self, b: int) -> np.ndarray:
        x = np.full(self.n, b, dtype=_U)
        x[0] = 1
        return np.multiply.accumulate(x)


_BYTE_POWERS, _GRAM_POWERS = _Powers(_BASE), _Powers(_GRAM)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), off


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Returns freed memory to the system: workers live on, beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of each slice."""
    data, off = flat(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    give_back()


def lowered(buf: np.ndarray) -> np.ndarray:
    """LOWER[buf], in byte arithmetic."""
    return buf + ((buf - np.uint8(65) < np.uint8(26)).view(np.uint8) << np.uint8(5))


def separators(buf: np.ndarray) -> np.ndarray:
    """IS_SEP[buf], in byte arithmetic."""
    return (buf == np.uint8(0x20)) | (buf - np.uint8(9) < np.uint8(5))


def words(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = IS_SEP, gap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each text (one more than texts); gap: sep[buf], where it is known."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    gap = sep[buf] if gap is None else gap
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = edge[:n].copy()
    before[1:] |= gap[:-1]
    after = edge[1:].copy()
    after[:-1] |= gap[1:]
    inside = ~gap
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (spans in ascending order, not overlapping)."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):  # in pieces, for bounded temporary arrays
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        part = buf[base : ends[j - 1]]
        up, down = _BYTE_POWERS.get(len(part) + 1)
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(_TABLE[part] * up[:-1], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U))
        i = j
    return out


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U)
LONG_WORD = 64


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, eight bytes at a time (not that of span_hashes)."""
    size = ends - starts
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    out = mix((eight[starts] & _MASKS[np.minimum(size, 8)]) + size.astype(_U) * _U(_BASE))
    left, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(left):
        out[left] = mix(out[left] + mix(eight[starts[left] + at] & _MASKS[np.minimum(size[left] - at, 8)]))
        at += 8
        left = left[size[left] > at]
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        out[long] = span_hashes(buf, starts[long], ends[long])
    return out


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive tokens of the whole array."""
    if len(tokens) < k:
        return np.empty(0, _U)
    up, down = _GRAM_POWERS.get(len(tokens) + 1)
    total = np.zeros(len(tokens) + 1, _U)
    np.cumsum(tokens * up[:-1], out=total[1:])
    n = len(tokens) - k + 1
    return mix((total[k:] - total[:n]) * down[:n])


def gram_bounds(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, its first k-gram and the one after its last (in gram_hashes' array)."""
    return first[:-1], np.maximum(first[1:] - k + 1, first[:-1])


def runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indices of the ranges lo[i]..hi[i]-1 in order, and the range that each is of."""
    n = hi - lo
    owner = np.repeat(np.arange(len(n)), n)
    total = np.cumsum(n)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(lo - (total - n), n), owner


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class HashMap:
    """Values of 64-bit keys, looked up all at once: open addressing in arrays of four to eight times the keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, (4 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, _U)
        self.values = np.zeros(1 << self.bits, values.dtype)
        used = np.zeros(1 << self.bits, bool)
        self.probes, left = 0, np.arange(len(keys))
        while len(left):
            at = (self._home(keys[left]) + self.probes) & ((1 << self.bits) - 1)
            free = np.flatnonzero(~used[at])
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]], used[at[won]] = keys[left[won]], values[left[won]], True
            left = np.delete(left, won)
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def replace(self, x: np.ndarray) -> np.ndarray:
        """x with the keys among them replaced by their values (keys are not 0)."""
        at = self._home(x)
        keys = self.keys[at]
        hit = keys == x
        out = x.copy()
        out[hit] = self.values[at[hit]]
        todo = np.flatnonzero(~hit & (keys != 0))
        at = at[todo]
        for _ in range(1, self.probes):
            at = (at + 1) & ((1 << self.bits) - 1)
            keys = self.keys[at]
            hit = keys == x[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (keys != 0)
            todo, at = todo[more], at[more]
            if not len(todo):
                break
        return out
