"""Hashes of words and shingles, a piece of text at a time, in array operations.

Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased. A word's hash is
a polynomial of its bytes' random values, mixed; a shingle's combines those of its words in order.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(2024)
_table = _rng.integers(0, 1 << 64, size=256, dtype=np.uint64, endpoint=False)
_table[65:91] = _table[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_base = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 2 * len(_powers)), _base)]))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the documents' words)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    edge = np.concatenate([[True], space[:-1]])
    begins = offsets[:-1]
    edge[begins[begins < n]] = True
    starts = np.flatnonzero(edge & ~space)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    first = np.zeros(n, np.int64)
    first[starts] = starts
    np.maximum.accumulate(first, out=first)
    at = np.arange(n) - first
    value = _table[data]
    value[space] = 0
    value *= powers(int(at.max()) + 1)[at]
    return mix(np.add.reduceat(value, starts)), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Each document's distinct shingles of ``width`` words, ascending; with fewer words, one
    shingle of all; without words, none."""
    h, at = words(data, offsets)
    s = h.copy()
    for k in range(1, width):
        m = max(0, len(h) - k)
        s[:m] = mix(s[:m] * np.uint64(0xD6E8FEB86659FD93) + h[k:])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(s[a : b - width + 1]))
        elif b > a:
            x = h[a : a + 1]
            for k in range(1, b - a):
                x = mix(x * np.uint64(0xD6E8FEB86659FD93) + h[a + k])
            out.append(mix(x + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
