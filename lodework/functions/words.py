"""Vectorised words, word hashes and window hashes over the UTF-8 bytes of many texts at once.

The word separators are ASCII, so texts are never decoded. Hashes are polynomials modulo
2^64 in random odd bases, finished with a 64-bit mixer; a prefix sum and a table of inverse
powers give the hash of every word and of every window without a loop in Python.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes or windows hashed at once; bounds the tables of powers.
BLOCK = 1 << 18

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    n = max(n, BLOCK)
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = (np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 4 * BLOCK:
            _tables[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and for each text the index of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~SEPARATOR[data]
    before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
    before[1:] = ~solid
    after[: n - 1] = ~solid[1:]
    before[offsets] = True
    after[offsets[offsets > 0] - 1] = True
    starts, ends = np.flatnonzero(solid & before[:n]), np.flatnonzero(solid & after[:n]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        at, to = starts[i], ends[j - 1]
        up, down = _powers(base, int(to - at))
        sums = np.zeros(to - at + 1, np.uint64)
        np.cumsum((data[at:to].astype(np.uint64) + np.uint64(1)) * up[: to - at], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def windows(hashes: np.ndarray, k: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of the k words from each position on; len(hashes) - k + 1 of them, whatever text they lie in."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    up, down = _powers(base, min(n, BLOCK) + k)
    for i in range(0, n, BLOCK):
        j = min(n, i + BLOCK)
        part = hashes[i : j + k - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[i:j] = (sums[k:] - sums[:-k]) * down[: j - i]
    return mix(out + np.uint64(k))


def text_of(first: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows() lie in one text."""
    of = text_of(first)
    return of[: len(of) - k + 1] == of[k - 1 :] if len(of) >= k else np.zeros(0, bool)
