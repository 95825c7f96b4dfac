"""Hashes of words and word shingles of many texts at once, in numpy over their bytes.

A word's hash is a polynomial over its bytes modulo 2**64 with random byte values, mixed; it comes from one running sum
over the buffer, so no word is made a Python object. Separators are ASCII, so UTF-8 bytes can be cut at them.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_RNG = np.random.default_rng(7)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _VALUE[_LOWER]  # A-Z hash as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and extended in steps of a power of two."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        have = _POWERS[base] = np.cumprod(have, dtype=U64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(buf: np.ndarray, size: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of a buffer of bytes."""
    inside = ~_SPACE[buf]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.zeros(len(buf) + 1, U64)
    np.cumsum(_VALUE[buf] * powers(_BASE, len(buf)), out=run[1:])
    return start, mix((run[end] - run[start]) * powers(_INVERSE, len(buf) + 1)[start] + (end - start).astype(U64))


def shingle_sets(texts: list[str], k: int, step: int = 1 << 19) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of k words; of fewer words, the whole sequence as one."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    held = 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass")
        part.append(b)
        held += len(b) + 1
        if held >= step:
            out += _sets(part, k)
            part, held = [], 0
    return out + _sets(part, k) if part else out


def _sets(part: list[bytes], k: int) -> list[np.ndarray]:
    buf = np.frombuffer(b" ".join(part) + b" ", np.uint8)
    first = np.cumsum([0] + [len(b) + 1 for b in part])
    start, h = word_hashes(buf)
    cut = np.searchsorted(start, first)
    n = len(h) - k + 1
    if n > 0:
        s = mix(h[:n] + U64(k))
        for j in range(1, k):
            s = mix(s * U64(_BASE) + h[j : j + n])
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            x = np.array([b - a], U64)
            for j in range(a, b):
                x = mix(x * U64(_BASE) + h[j] + U64(1))
            out.append(x)
        else:
            out.append(np.zeros(0, U64))
    return out
