"""Anchors: local minima of hashed byte k-grams (winnowing; Schleimer, Wilkerson and Aiken 2003).

Of every window of `size` bytes one k-gram, that of least hash (the first of equals), is the window's anchor. It depends
on the window's bytes alone, so equal windows have equal anchors at equal places. Consecutive windows with one anchor
make a segment; segments of one document cover all of its windows.
"""

from __future__ import annotations

import numpy as np

from lodeline.llm.shingles import U64, mix, powers

_RNG = np.random.default_rng(17)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)


class Rolling:
    """Hashes of any stretch of a buffer of bytes."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.run = np.zeros(n + 1, U64)
        np.cumsum(_VALUE[buf] * powers(_BASE, n), out=self.run[1:])
        self.back = powers(_INVERSE, n + 1)

    def grams(self, k: int) -> np.ndarray:
        x = (self.run[k:] - self.run[:-k]) * self.back[: len(self.run) - k]
        return mix(x)

    def stretches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.run[end] - self.run[start]) * self.back[start] + (end - start).astype(U64))


#: Low bits of a gram's hash that its place takes while minima are taken; longer texts are worked in pieces.
PLACE_BITS = 24


def segments(buf: np.ndarray, size: int, k: int, most: int = (1 << PLACE_BITS) - 4096) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor hash, segment hash) of each segment of one text, in order.

    Windows of a segment have their anchor at one place, so no two windows of a segment are equal.
    """
    parts = [_segments(buf[a : a + most + size - 1], size, k, a) for a in range(0, max(1, len(buf) - size + 1), most)]
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))


def _segments(buf: np.ndarray, size: int, k: int, base: int) -> tuple[np.ndarray, ...]:
    if len(buf) < size:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U64), none.astype(U64)
    roll = Rolling(buf)
    g = roll.grams(k)
    w = size - k + 1
    bits = U64(PLACE_BITS)
    low = (g >> bits << bits) | np.arange(len(g), dtype=U64)
    span = 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    count = np.diff(np.append(first, len(low)))
    place = (low[first] & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    return first + base, count, g[place], roll.stretches(first, first + count - 1 + size)
