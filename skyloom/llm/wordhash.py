"""Words of many texts at once, and 64-bit hashes of words and of word windows, as numpy arrays."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the output."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of one slice of texts: start and end (byte offsets), hash, and first (where each text's words begin, and the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        if lower:
            data = _LOWER[data]
        n = len(data)
        solid = ~_SPACE[data]
        fresh = np.zeros(n + 1, bool)
        fresh[offsets] = True
        edge = np.empty(n + 1, bool)  # no word goes on from the byte before
        edge[0] = True
        edge[1:n] = ~solid[:-1]
        edge |= fresh
        self.data = data
        self.start = np.flatnonzero(solid & edge[:-1])
        ahead = np.empty(n + 1, bool)
        ahead[n] = True
        ahead[:n] = ~solid
        ahead |= fresh
        self.end = np.flatnonzero(solid & ahead[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        size = self.end - self.start
        if len(size):
            place = np.arange(n, dtype=np.int32)
            place[solid] -= np.repeat(self.start.astype(np.int32), size)
            values = (data.astype(U) + U(1)) * powers(int(size.max()) + 1)[np.where(solid, place, 0)]
            values[~solid] = 0
            sums = np.add.reduceat(values, self.start)
            self.hash = mixed(sums + size.astype(U) * U(0xD6E8FEB86659FD93))
        else:
            self.hash = np.zeros(0, U)

    @property
    def text_of(self) -> np.ndarray:
        """The text's number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, size: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
        """The hash of the `size` words from each word on; those of the last size - 1 words of a text mean nothing."""
        p = powers(size, base | 1)
        h = np.append(self.hash, np.zeros(size, U))
        out = np.zeros(len(self.hash), U)
        for k in range(size):
            out += h[k : k + len(out)] * p[k]
        return mixed(out)

    def whole(self, size: int) -> np.ndarray:
        """Whether the `size` words from each word on lie in its text."""
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hash))
        return left >= size
