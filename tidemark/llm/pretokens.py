"""Vectorised splitting of text into byte-level BPE pre-tokens.

The rule is public_tokenizers.PATTERN:
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
Texts are handled as one array of code points with a class for each, so the
borders of all pre-tokens of a slice come from a few array operations.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

from .words import mix, powers

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    t = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    for i in range(sys.maxunicode + 1):
        c = kind.get(unicodedata.category(chr(i))[0])
        if c is not None:
            t[i] = c
    t[list(WHITE_SPACE)] = SPACE
    return t


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, str]:
    """The code points of all texts one after another, their borders, and the joined text."""
    whole = "".join(texts)
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return np.frombuffer(whole.encode("utf-32-le"), np.uint32), offs, whole


def split(points: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every pre-token, with the total length at the end, and each text's first pre-token."""
    n = len(points)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(offs), np.int64)
    kind = classes()[points]
    head = np.zeros(n + 1, bool)  # first character of a text
    head[offs[:-1]] = True
    head[n] = True
    space = kind == SPACE
    edge = head[:n].copy()  # a run of one class starts
    edge[1:] |= kind[1:] != kind[:-1]
    start = edge.copy()
    # White space before something else: its last character leaves the run, and
    # if that is a blank, joins what follows.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~head[1:n]
    at = np.flatnonzero(last)
    start[at] = True
    blank = at[points[at] == 32]
    start[blank + 1] = False
    # Contractions: an apostrophe that starts a pre-token, with what follows it.
    mark = np.flatnonzero((points == 39) & start)
    if len(mark):
        nxt = np.zeros((3, len(mark)), np.uint32)
        for j in (1, 2):
            ok = mark + j < n
            at = np.minimum(mark + j, n - 1)
            own = np.searchsorted(offs, at, "right") == np.searchsorted(offs, mark, "right")
            nxt[j] = np.where(ok & own, points[at], 0)
        one = np.isin(nxt[1], [ord(c) for c in "stmd"])
        two = (nxt[1] == ord("r")) & (nxt[2] == ord("e")) | (nxt[1] == ord("v")) & (nxt[2] == ord("e")) | (nxt[1] == ord("l")) & (nxt[2] == ord("l"))
        for found, size in ((one, 2), (two & ~one, 3)):
            at = mark[found]
            for j in range(1, size):
                start[at + j] = False
            rest = at[at + size < n] + size  # letters left over start a pre-token; anything else starts one anyway
            start[rest[kind[rest] == LETTER]] = True
    cuts = np.flatnonzero(start)
    return np.r_[cuts, n], np.searchsorted(cuts, offs)


def span_hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans between consecutive starts."""
    if len(starts) < 2:
        return np.zeros(0, np.uint64)
    n = len(points)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    value = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    value ^= value >> np.uint64(31)
    np.cumsum(value * power[:n], out=sums[1:])
    a, b = starts[:-1], starts[1:]
    return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
