"""Word and shingle hashes of whole batches of texts, with numpy on Arrow's UTF-8 bytes.

A word is a run of bytes other than space and 0x09-0x0D. Words get 64-bit polynomial hashes from
prefix sums, so that no Python object is made for a word. Equal words have equal hashes.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges."""
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


class Words:
    """Words of the rows of a batch: `start`, `end` (bytes), `hash`, and `first`, each row's first word."""

    def __init__(self, data: np.ndarray, at: np.ndarray, separators: np.ndarray = SEPARATOR):
        n = len(data)
        separator = separators[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0] = after[-1] = True
            before[1:], after[:-1] = separator[:-1], separator[1:]
            before[at[:-1][at[:-1] < n]] = True
            after[at[1:][at[1:] > 0] - 1] = True
        self.separator = separator
        self.start = np.flatnonzero(~separator & before)
        self.end = np.flatnonzero(~separator & after) + 1
        self.first = np.searchsorted(self.start, at)
        self.hash = spans(data, self.start, self.end)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of n words within a row, and the windows' hashes."""
        count = len(self.hash)
        if count < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = self.hash[: count - n + 1].copy()
        for k in range(1, n):
            h *= STEP
            h += self.hash[k : count - n + 1 + k]
        ok = np.ones(count - n + 1, bool)
        for k in range(1, n):  # windows that reach over a row's end
            cut = self.first[1:] - k
            ok[cut[(cut >= 0) & (cut < len(ok)) & (cut >= self.first[:-1])]] = False
        at = np.flatnonzero(ok)
        return at, mix(h[at])
