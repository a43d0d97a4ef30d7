"""Runs of windows that share an anchor, packed for a shuffle by anchor.

Every window of a text has an anchor: the least hash of the short grams inside it.  Equal windows have equal anchors,
so they meet in the block that an anchor belongs to; neighbouring windows with one anchor travel as one run.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    out, step = x, 1
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs_of(anchor: np.ndarray, text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, size) of the maximal stretches of windows, `most` at most, with one anchor in one text; anchor and text belong to windows that follow each other."""
    if not len(anchor):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(anchor)))
    if (size > most).any():
        parts = -(-size // most)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, end = np.repeat(first, parts) + k * most, np.repeat(first + size, parts)
        size = np.minimum(end - first, most)
    return first, size


def expanded(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of size."""
    total = np.cumsum(size) if len(size) else np.zeros(1, np.int64)
    return np.arange(total[-1]) - np.repeat(total - size, size) + np.repeat(first, size)


def repeated(*keys: np.ndarray) -> np.ndarray:
    """Whether each row's keys are found in another row."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, bool)
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0])
    same = np.ones(n - 1, bool)
    for k in keys:
        s = k[order]
        same &= s[1:] == s[:-1]
    out = np.zeros(n, bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def groups(sorted_keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, first, end) of each stretch of equal keys."""
    if not len(sorted_keys):
        return []
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return list(zip(sorted_keys[first].tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_keys)], strict=True))
