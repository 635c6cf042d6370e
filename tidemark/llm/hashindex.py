"""An open-addressing map from 64-bit hashes to row numbers, in numpy arrays."""

from __future__ import annotations

import numpy as np


class HashIndex:
    """Numbers the distinct non-zero hashes put in, 0, 1, 2, ... by order of arrival.

    Places come from a product with an odd constant, as the hashes one task
    holds may share their leading bits (they were dealt by them).
    """

    _SPREAD = np.uint64(0x9FB21C651E98DF25)

    def __init__(self, bits: int = 12):
        self._alloc(bits)
        self.n = 0

    def _alloc(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.zeros(1 << bits, np.int32)
        self.bits = bits

    def get(self, h: np.ndarray) -> np.ndarray:
        """Row number of each hash, -1 where it is absent."""
        out = np.full(len(h), -1, np.int32)
        at = ((h * self._SPREAD) >> self.shift).astype(np.int64)
        key = self.keys[at]
        hit = key == h
        out[hit] = self.rows[at[hit]]
        left = np.flatnonzero(~hit & (key != 0))
        at = at[left]
        mask = len(self.keys) - 1
        while len(left):
            at = (at + 1) & mask
            key = self.keys[at]
            hit = key == h[left]
            out[left[hit]] = self.rows[at[hit]]
            go = ~hit & (key != 0)
            left, at = left[go], at[go]
        return out

    def add(self, new: np.ndarray) -> None:
        """Adds distinct hashes that are absent, in this order."""
        rows = np.arange(self.n, self.n + len(new), dtype=np.int32)
        self.n += len(new)
        if self.n * 2 > len(self.keys):
            used = self.keys != 0
            old, old_rows = self.keys[used], self.rows[used]
            self._alloc(max(self.bits + 1, int(self.n * 3).bit_length()))
            self._put(old, old_rows)
        self._put(new, rows)

    def _put(self, h: np.ndarray, rows: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = ((h * self._SPREAD) >> self.shift).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = h[free]
            won = free[self.keys[at[free]] == h[free]]
            self.rows[at[won]] = rows[won]
            done = np.zeros(len(h), bool)
            done[won] = True
            left = left[~done[left]]
            at[left] = (at[left] + 1) & mask


class Lists:
    """Growing list of integer lists, kept flat."""

    def __init__(self, kind=np.int32):
        self.flat = np.zeros(1024, kind)
        self.first = np.zeros(1024, np.int64)
        self.n = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        end = int(self.first[self.n])
        self.flat = self._room(self.flat, end + len(flat))
        self.first = self._room(self.first, self.n + len(sizes) + 1)
        self.flat[end : end + len(flat)] = flat
        self.first[self.n + 1 : self.n + 1 + len(sizes)] = end + np.cumsum(sizes)
        self.n += len(sizes)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these rows one after another, and each one's end."""
        start = self.first[rows]
        size = self.first[rows.astype(np.int64) + 1] - start
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(start - (ends - size), size) + np.arange(total)
        return self.flat[at], ends
