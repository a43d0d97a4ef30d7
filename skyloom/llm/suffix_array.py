"""Suffix arrays by induced sorting, and permuted common prefixes, as whole-array operations.

Suffixes are classified, the substrings between leftmost smaller positions sorted by induction and named; where names
repeat, names are paired and named anew until they differ or reach `depth`; the sorted suffixes then induce all others.
A bucket is induced as a whole: what its suffixes put in front of themselves is dealt to buckets by one stable sort.
"""

from __future__ import annotations

import numpy as np


def smaller_types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last counts as such."""
    n = len(s)
    out = np.ones(n, bool)
    if n > 1:
        rises, differ = s[1:] > s[:-1], s[1:] != s[:-1]
        differs = np.flatnonzero(differ)
        after = np.cumsum(differ) - differ  # so many differences are before each place
        out[:-1] = np.append(rises[differs], False)[after]
    return out


def _deal(pending: list, items: np.ndarray, symbols: np.ndarray) -> None:
    order = np.argsort(symbols, kind="stable")
    items, symbols = items[order], symbols[order]
    cut = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    if len(items):
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(items)], strict=True):
            pending[symbols[a]].append(items[a:b])


def induced(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """The order of all suffixes that the given order of the leftmost smaller ones induces."""
    none = np.zeros(0, np.int64)
    seed_symbol = s[seeds]
    seed_order = np.argsort(seed_symbol, kind="stable")
    seeds, seed_symbol = seeds[seed_order], seed_symbol[seed_order]
    seed_cut = np.searchsorted(seed_symbol, np.arange(symbols + 1))
    pending: list[list] = [[] for _ in range(symbols)]
    larger: list[np.ndarray] = [none] * symbols
    for c in range(symbols):
        parts, front = [], np.concatenate([none, *pending[c]])
        while len(front):
            parts.append(front)
            before = front[front > 0] - 1
            before = before[~smaller[before]]
            ch = s[before]
            own = ch == c
            _deal(pending, before[~own], ch[~own])
            front = before[own]
        larger[c] = np.concatenate([none, *parts])
        mine = seeds[seed_cut[c] : seed_cut[c + 1]]
        before = mine[mine > 0] - 1
        before = before[~smaller[before]]
        _deal(pending, before, s[before])
        pending[c] = []
    pending = [[] for _ in range(symbols)]
    pending[int(s[-1])].append(np.array([len(s) - 1]))
    out: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):
        parts, front = [], np.concatenate([none, *pending[c]])
        while len(front):
            parts.append(front)
            before = front[front > 0] - 1
            before = before[smaller[before]]
            ch = s[before]
            own = ch == c
            _deal(pending, before[~own], ch[~own])
            front = before[own]
        mine = larger[c][::-1]
        before = mine[mine > 0] - 1
        before = before[smaller[before]]
        _deal(pending, before, s[before])
        out += [*parts, mine]
        pending[c] = []
    return np.concatenate(out)[::-1]


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of s in the order of their first `depth` symbols at least; s: small integers, the last one less than all others."""
    n, symbols = len(s), int(s.max()) + 1
    s = s.astype(np.uint16)
    smaller = smaller_types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(lms):
        return induced(s, smaller, np.array([n - 1]), symbols)
    # The order of the substrings between such positions, and equal names for equal ones.
    rank_of = np.full(n, -1, np.int64)
    rank_of[lms] = np.arange(len(lms))
    order = induced(s, smaller, lms, symbols)
    sorted_lms = rank_of[order]
    sorted_lms = sorted_lms[sorted_lms >= 0]
    power = np.multiply.accumulate(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))
    ends = np.append(lms[1:], n - 1)
    size = ends - lms + 1
    place = np.arange(lms[0], n) - np.repeat(lms, np.append(np.diff(lms), n - lms[-1]))
    values = (s[lms[0] :].astype(np.uint64) * np.uint64(2) + smaller[lms[0] :]) * power[place & 4095] * (place.astype(np.uint64) // np.uint64(4096) * np.uint64(2) + np.uint64(1))
    name = np.add.reduceat(values, lms - lms[0])
    name += (s[ends].astype(np.uint64) + np.uint64(size.max() + 7)) * (size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    a, b = sorted_lms[1:], sorted_lms[:-1]
    new = (name[a] != name[b]) | (size[a] != size[b])
    ranks = np.empty(len(lms), np.int64)
    ranks[sorted_lms] = np.maximum.accumulate(np.where(np.concatenate([[True], new]), np.arange(len(lms)), 0))
    reach, tied = 1, sorted_lms  # those whose rank another one has too, by rank
    while 2 * reach < depth + 2:  # a substring has two symbols at least
        r = ranks[tied]
        many = np.concatenate([[False], r[1:] == r[:-1]])
        many[:-1] |= many[1:]
        tied, r = tied[many], r[many]
        if not len(tied):
            break
        key = r * (len(lms) + 1) + np.append(ranks, np.full(reach, -1))[tied + reach] + 1
        turn = np.argsort(key)
        tied, key, r = tied[turn], key[turn], r[turn]
        # A rank counts those before it, so that ranks of others stay as they are.
        place = np.arange(len(tied))
        head = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), place, 0))
        base = np.maximum.accumulate(np.where(np.concatenate([[True], r[1:] != r[:-1]]), place, 0))
        ranks[tied] = r + head - base
        reach *= 2
    return induced(s, smaller, lms[np.argsort(ranks)], symbols)


def permuted_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, by its place in data: whole 8-byte words, up to `most` bytes, that it shares with its predecessor in the order; `most` if they share so many bytes."""
    n = len(data)
    padded = np.append(data, np.zeros(most + 8, np.uint8))
    word = np.zeros(n + most, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : k + n + most]
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int32)
    alive = np.flatnonzero(before >= 0)
    for at in [*range(0, most - 7, 8), most - 8]:
        alive = alive[word[alive + at] == word[before[alive] + at]]
        out[alive] = at + 8
    return out
