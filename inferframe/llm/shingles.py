"""Words and word shingles of whole texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWER = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Bytes that words() works on at a time, so that its temporary arrays (some 40 bytes for each) stay small beside a very long text.
WINDOW = 1 << 20


def _windows(data: np.ndarray, off: np.ndarray, separators: np.ndarray, window: int):
    """Ranges of about window bytes that end at a separator or between texts, so that no run is cut."""
    lo, n = 0, len(data)
    while lo < n:
        hi = lo + window
        while hi < n:
            some = np.flatnonzero(separators[data[hi : hi + window]])
            edge = off[np.searchsorted(off, hi)] if off[-1] >= hi else n
            at = hi + int(some[0]) if len(some) else hi + window
            hi = min(at, int(edge))
            if len(some) or hi == edge:
                break
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that separators doesn't mark, never across texts: (start, end, hash of the run with A-Z lowered, n + 1 offsets of texts in words)."""
    found = []
    for lo, hi in _windows(data, off, separators, window):
        inner = off[np.searchsorted(off, lo, "right") : np.searchsorted(off, hi)] - lo
        start, end, h = _words(data[lo:hi], inner, separators)
        found.append((start + lo, end + lo, h))
    z = np.zeros(0, np.int64)
    start, end, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (z, z, z.astype(np.uint64))
    return start, end, h, np.searchsorted(start, off)


def _words(data: np.ndarray, edges: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the runs of one window; edges are the starts of texts inside it."""
    inside = ~separators[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[edges] |= inside[edges]
    start = np.flatnonzero(begin)
    if len(start) == 0:
        return start, start, start.astype(np.uint64)
    at = np.flatnonzero(inside)
    length = np.diff(np.append(np.searchsorted(at, start), len(at)))
    within = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    power = np.ones(int(length.max()), np.uint64)
    power[1:] = POWER
    power = np.cumprod(power)
    h = BYTE[LOWER[data[at]]] * power[within]
    h = np.add.reduceat(h, np.cumsum(length) - length)
    return start, start + length, mix(h + length.astype(np.uint64))


def folded(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes."""
    out = h[: max(0, len(h) - n + 1)]
    for k in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return out


def distinct_shingles(h: np.ndarray, n: int, most: int = 1 << 18) -> np.ndarray:
    """Distinct n-word shingles of a text's word hashes, ascending; of fewer words, one shingle of them all. A long text goes in runs of most words."""
    if len(h) < n:
        return folded(h, len(h)) if len(h) else h
    if len(h) <= most:
        return np.unique(folded(h, n))
    return np.unique(np.concatenate([np.unique(folded(h[i : i + most + n - 1], n)) for i in range(0, len(h) - n + 1, most)]))


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles, ascending; a text of fewer words is one shingle of them all, one without words is empty."""
    _, _, h, w = words(data, off)
    return [distinct_shingles(h[a:b], n) for a, b in zip(w[:-1], w[1:], strict=True)]
