"""Hashes of words and of word windows for a batch of texts, in NumPy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_240_817)
#: A random value for each byte, and odd multipliers for places in a word and in a window.
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
WINDOW = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    out = np.full(n, STEP)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of other than ASCII white space), and the first word of each text with the total at the end."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if lower:
        data = LOWER[data]
    space = SPACE[data]
    edges = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    first = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.empty(0, np.uint64), first
    lengths = ends - starts
    table = powers(int(lengths.max()))
    at = np.flatnonzero(~space)
    place = at - np.repeat(starts, lengths)
    values = BYTE[data[at]] * table[place]
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return mix(np.add.reduceat(values, heads) + lengths.astype(np.uint64)), first


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words of one text; of the whole sequence if it has fewer; none if it has no words."""
    n = len(h)
    if not n:
        return h
    size = min(k, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out += mix(h[i : n - size + 1 + i] * WINDOW[i])
    return mix(out)
