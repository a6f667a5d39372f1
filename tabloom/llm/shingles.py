"""Word shingles of texts as 64-bit hashes, computed over whole Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tabloom.llm.common import utf8_slices

WIDTH = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n - 1."""
    if not _POWERS or len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(max(n, 1 << 16), b, dtype=np.uint64)
            p[0] = 1
            p = np.cumprod(p, dtype=np.uint64)
            _POWERS[k: k + 1] = [p]
    return _POWERS[0], _POWERS[1]


def word_hashes(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word: A-Z lower-cased runs without ASCII white space."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = _LOWER[data]
    space = _SPACE[x]
    first = np.zeros(len(x) + 1, dtype=bool)
    first[off] = True
    before = np.append(True, space[:-1]) | first[:-1]
    after = np.append(space[1:], True) | first[1:]
    s = np.flatnonzero(~space & before)
    e = np.flatnonzero(~space & after) + 1
    up, down = _powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], dtype=np.uint64, out=sums[1:])
    h = (sums[e] - sums[s]) * down[s]
    return mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(off, s, side="right") - 1


def _chain(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    acc = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        acc = mix(acc * np.uint64(0xA0761D6478BD642F) + words[at + k])
    return acc


def shingle_sets(off: np.ndarray, data: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each row; a row of fewer words has one shingle, an empty one none."""
    words, row = word_hashes(off, data)
    n = len(off) - 1
    ends = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(ends)
    full = np.flatnonzero(row[: max(0, len(row) - width + 1)] == row[width - 1:]) if len(row) >= width else np.zeros(0, np.int64)
    hashes = _chain(words, full, width)
    cuts = np.searchsorted(row[full], np.arange(n + 1)) if len(full) else np.zeros(n + 1, np.int64)
    out = [np.unique(hashes[cuts[i]: cuts[i + 1]]) for i in range(n)]
    for k in range(1, width):
        rows = np.flatnonzero(count == k)
        if len(rows):
            for i, h in zip(rows.tolist(), _chain(words, ends[rows], k), strict=True):
                out[i] = np.array([h], dtype=np.uint64)
    return out


def column_sets(column, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The shingle set of each row of an Arrow string column, in order."""
    for _, _, off, data in utf8_slices(column, 1 << 20):
        yield from shingle_sets(off, data, width)


def set_id(tokens: np.ndarray) -> int:
    """64-bit id of a shingle set (as a signed integer)."""
    total = (int(mix(tokens).sum(dtype=np.uint64)) + len(tokens) * int(_BASE)) % (1 << 64)
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])
