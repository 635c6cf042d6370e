"""Vectorised word splitting and hashing over Arrow string columns.

A column is cut into slices of bounded bytes (one longer document makes a
slice of its own), and every slice is handled as one byte array: word
borders come from a byte table, word hashes from prefix sums of a polynomial
modulo 2**64, so no Python loop runs over words.
"""

from __future__ import annotations

import ctypes
import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@functools.cache
def _byte_values() -> np.ndarray:
    """A random 64-bit odd number for each byte, A-Z valued as a-z."""
    t = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    t[65:91] = t[97:123]
    return t


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size > SLICE_BYTES * 4:  # one very long text: do not keep the tables
            return out[0], out[1]
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def blanks_split() -> np.ndarray:
    """Word bytes of the class [^\\x20\\x09-\\x0D]."""
    t = np.ones(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = False
    return t


def alnum_split() -> np.ndarray:
    """Word bytes of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] once A-Z is lower-cased."""
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = True
    t[128:] = True
    return t


BLANKS, ALNUM = blanks_split(), alnum_split()


@dataclass
class Slice:
    """Some consecutive rows of a text column: bytes and row borders."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray  # hi - lo + 1 offsets into data


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # first word of each row, and the total


def as_strings(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


@functools.cache
def _malloc_trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Gives free memory back to the system, which a waiting worker would keep."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim() is not None:
        _malloc_trim()(0)


def slices(column, limit: int = SLICE_BYTES):
    """Slices of a string column, each of at most `limit` bytes or one row; nulls are empty."""
    arr = as_strings(column)
    n = len(arr)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    offs = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Slice(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi
    trim()


def find_words(s: Slice, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every row."""
    n = len(s.data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(s.offs), np.int64)
    inside = table[s.data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = s.offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, s.offs)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, A-Z hashed as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * power[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def words(s: Slice, table: np.ndarray) -> Words:
    starts, ends, bounds = find_words(s, table)
    return Words(starts, ends, hash_spans(s.data, starts, ends), bounds)


def word_hash(word: bytes) -> int:
    """The hash that `words` gives to one word."""
    data = np.frombuffer(word, np.uint8)
    return int(hash_spans(data, np.zeros(1, np.int64), np.array([len(data)]))[0])


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values (row borders are the caller's)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * np.uint64(pow(0xA0761D6478BD642F, j + 1, 1 << 64))
    return mix(out + np.uint64(k))


def run_hash(h: np.ndarray) -> np.ndarray:
    """The hash `rolling` gives to the whole of h as one run."""
    return rolling(h, len(h))
