"""A byte-pair tokenizer compiled, as it is needed, to a deterministic transducer over bytes.

A state stands for what the rest of a pre-token may depend on: the longest suffix read that begins some vocabulary
entry, and for each of its positions where an entry may begin the last token of the encoding up to there.  A
transition carries the change of the number of tokens.  The last token is found by the rule that a sequence is the
encoding exactly if each two neighbours encode to themselves; the library is asked for that, once a pair.

Texts run as lanes (chunks) of bytes, all lanes one step at a time.  A pre-token boundary maps every state to the first
one, so the map of a lane with a boundary is constant.  Of lanes without one the maps are kept for the start states that
occur, and composed by a parallel prefix scan; where it meets a start state whose image isn't known, that lane's map is
run from it, all such lanes side by side, and the scan is made again.  Lanes of equal bytes share a map.
"""

from __future__ import annotations

import json
import struct

import numpy as np

LETTER, NUMBER, BLANK, MARK, UNKNOWN = 0, 1, 2, 3, 9
LANE = 256
SHIFT, BIAS = 6, 32
#: Bytes that the table has room for at first, and the states beyond which it is compiled anew.
COLUMNS, MOST_STATES = 128, 500_000
#: The states that have a row of the table.  Later ones are met seldom and go on in few ways: their transitions are kept one by one.
DENSE = 1 << 16
SPECIAL = "<|endoftext|>"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def packed_key(suffix: bytes, starts) -> bytes:
    """A state as bytes, a quarter of the room of nested tuples."""
    return struct.pack(f"<H{3 * len(starts)}i", len(starts), *(x for s in starts for x in s)) + suffix


def unpacked_key(key: bytes) -> tuple[bytes, list[tuple[int, int, int]]]:
    ends = 2 + 12 * int.from_bytes(key[:2], "little")
    return key[ends:], list(struct.iter_unpack("<3i", key[2:ends]))


class Transducer:
    """Compiled from a tokenizer file with a byte-level BPE model (GPT-2's pre-token pattern, no normalizer)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level tokenizer")
        self.model, self.split = tokenizer.model, tokenizer.pre_tokenizer
        self.chars = byte_chars()
        back = {c: b for b, c in enumerate(self.chars)}
        self.tokens = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in back for c in t)}
        self.special = next((a["id"] for a in spec["added_tokens"] if a["content"] == SPECIAL), None)
        self.bytes_of = {i: t for t, i in self.tokens.items()}
        self.length = np.zeros(max(self.bytes_of) + 2, np.int32)
        for i, t in self.bytes_of.items():
            self.length[i] = len(t)
        self.begins = {t[:k] for t in self.tokens for k in range(1, len(t))}  # what can still grow to an entry
        self.reset()
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)

    # -- compilation -------------------------------------------------------------------------------------------
    def reset(self) -> None:
        """Forgets what was compiled."""
        first = packed_key(b"", [(0, -1, 0)])
        self.states = {first: 0, None: 1}
        self.keys = [first, None]  # 1: not begun, until the first boundary of a lane
        self.pairs = {}
        self.column, self.byte = np.full(256, 255, np.uint8), []  # bytes get columns as they are met
        self.table, self.rare = np.full((min(4096, DENSE), COLUMNS), -1, np.int32), {}
        self.table[1] = (1 << SHIFT) | BIAS
        self.last = np.full(4096, -1, np.int32)

    def columns(self, data: np.ndarray) -> np.ndarray:
        """data by columns of the table."""
        for b in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if b not in self.byte:
                self.column[b] = len(self.byte)
                self.byte.append(b)
        if len(self.byte) > self.table.shape[1]:
            wide = np.full((len(self.table), 256), -1, np.int32)
            wide[1] = self.table[1, 0]
            before = self.table.shape[1]
            wide[:, :before] = self.table
            self.table, self.rare = wide, {i // before * 256 + i % before: to for i, to in self.rare.items()}
        return self.column[data]

    def stands(self, left: int, right: int) -> bool:
        """Whether left and right, or right alone where left is -1, encode to themselves."""
        pair = (left + 1) << 32 | right
        if (found := self.pairs.get(pair)) is None:
            want = [right] if left < 0 else [left, right]
            text = "".join(self.chars[b] for i in want for b in self.bytes_of[i])
            found = self.pairs[pair] = [t.id for t in self.model.tokenize(text)] == want
        return found

    def step(self, state: int, byte: int) -> int:
        """Compiles one transition: the packed next state and change of the count."""
        suffix, starts = unpacked_key(self.keys[state])
        grown, cut = suffix + bytes([byte]), len(suffix)
        for n, left, more in starts:  # longest first
            token = self.tokens.get(grown[cut - n :])
            if token is not None and self.stands(left, token):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        change = more + 1
        kept = [(n + 1, left, more - change) for n, left, more in starts if grown[cut - n :] in self.begins]
        key = packed_key(grown[len(grown) - kept[0][0] :] if kept else b"", [*kept, (0, token, 0)])
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.keys)
            self.keys.append(key)
            if len(self.table) <= to < DENSE:
                more = min(len(self.table) // 2, DENSE - len(self.table))
                self.table = np.concatenate([self.table, np.full((more, self.table.shape[1]), -1, np.int32)])
            if to >= len(self.last):
                self.last = np.concatenate([self.last, np.full(len(self.last) // 2, -1, np.int32)])
            self.last[to] = token
        if not -BIAS <= change < BIAS:
            raise ValueError("a transition changes the count by too much")
        packed = (to << SHIFT) | (change + BIAS)
        if state < DENSE:
            self.table[state, self.column[byte]] = packed
        else:
            self.rare[state * self.table.shape[1] + int(self.column[byte])] = packed
        return packed

    # -- pre-tokens --------------------------------------------------------------------------------------------
    def classes(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kind[points]
        if (kinds == UNKNOWN).any():
            for p in np.unique(points[kinds == UNKNOWN]).tolist():
                alone = lambda before: len(self.split.pre_tokenize_str(before + chr(p))) == 1  # noqa: E731, B023
                self.kind[p] = LETTER if alone("a") else NUMBER if alone("1") else MARK if alone("!") else BLANK
            kinds = self.kind[points]
        return kinds

    def boundaries(self, points: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Where a pre-token begins, by code point; fresh: where a text (or what stands between special tokens) begins."""
        kinds = self.classes(points)
        n = len(points)
        blank = kinds == BLANK
        before = np.empty_like(kinds)
        before[0] = UNKNOWN
        before[1:] = kinds[:-1]
        starts = fresh | (kinds != before)
        after_space = np.zeros(n, bool)
        after_space[1:] = points[:-1] == 0x20
        starts &= ~(after_space & ~blank & ~fresh)  # a space joins what follows it
        solid_next = np.zeros(n, bool)
        solid_next[:-1] = ~blank[1:] & ~fresh[1:]
        starts |= blank & solid_next  # the last blank of a run stands apart
        quotes = np.flatnonzero((points == 0x27) & starts)
        if len(quotes):
            at = lambda k: np.where((quotes + k < n), points[np.minimum(quotes + k, n - 1)], 0)
            new = lambda k: np.where((quotes + k < n), fresh[np.minimum(quotes + k, n - 1)], True)
            a, b = at(1), at(2)
            two = np.isin(a, [ord(c) for c in "stmd"]) & ~new(1)
            three = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (a == ord("l")) & (b == ord("l"))) & ~new(1) & ~new(2)
            starts[quotes[two | three] + 1] = False
            for q, k in ((quotes[two], 2), (quotes[three & ~two], 3)):
                ends = q + k
                starts[ends[ends < n]] = True
        return starts

    # -- running -----------------------------------------------------------------------------------------------
    def run(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The packed transition (state after it, change of the count) of each byte."""
        if len(self.keys) > MOST_STATES:
            self.reset()
        n = len(data)
        lanes = -(-n // LANE)
        data = self.columns(data)
        grid = np.zeros((2, lanes * LANE), np.uint8)
        grid[0, :n], grid[1, :n] = data, starts
        goes_on = (1 - grid[1]).reshape(lanes, LANE).T.copy()
        read = grid[0].reshape(lanes, LANE).T.copy()
        taken = np.empty((LANE, lanes), np.int32)
        every = np.arange(lanes)
        self.pass_over(read, goes_on, taken, np.ones(lanes, np.int32), LANE)
        # A lane's map is constant from its first boundary on; before that, its head waits for the state it begins in.
        heads = np.where(goes_on.all(axis=0), LANE, goes_on.argmin(axis=0))
        ends = taken[LANE - 1] >> SHIFT
        whole = every[heads == LANE]
        if len(whole):
            ends[whole] = self.composed(read, whole, ends)
        todo = every[heads > 0]
        if len(todo):
            most = int(heads[todo].max())
            part = np.empty((most, len(todo)), np.int32)
            self.pass_over(read[:most, todo], goes_on[:most, todo], part, ends[todo - 1], most)
            rows, columns = np.nonzero(np.arange(most)[:, None] < heads[todo])
            taken[rows, todo[columns]] = part[rows, columns]
        return taken.T.reshape(-1)[:n]

    def composed(self, read: np.ndarray, lanes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The states at the ends of lanes without a boundary (ascending numbers); ends: those of all other lanes."""
        rows = np.ascontiguousarray(read[:, lanes].T)
        _, example, content = np.unique(rows.view(f"V{LANE}").reshape(-1), return_index=True, return_inverse=True)
        content = content.reshape(-1)
        first = np.flatnonzero(np.diff(lanes, prepend=-1) > 1)  # of each run of neighbours; a text's first byte is a boundary
        key = lambda c, state: c.astype(np.int64) << 32 | state
        keys, images = np.zeros(0, np.int64), np.zeros(0, np.int64)  # known: (content, start state), ascending, and the end state
        fresh = np.unique(np.concatenate([key(np.arange(len(example)), 0), key(content[first], ends[lanes[first] - 1])]))
        while True:
            # The maps from new start states, all side by side.
            of, state = fresh >> 32, (fresh & 0xFFFFFFFF).astype(np.int32)
            part = np.empty((LANE, len(fresh)), np.int32)
            self.pass_over(np.ascontiguousarray(rows[example[of]].T), np.ones((LANE, len(fresh)), np.uint8), part, state, LANE)
            new = part[-1].astype(np.int64) >> SHIFT
            order = np.argsort(np.concatenate([keys, fresh]), kind="stable")
            keys, images = np.concatenate([keys, fresh])[order], np.concatenate([images, new])[order]
            start_of = lambda k: np.minimum(np.searchsorted(keys, k), len(keys) - 1)  # noqa: E731, B023
            # Each lane's map on the places of its content's known start states, into those of the next lane's; the
            # place `most` stands for an unknown one, and the first lane of a run is constant.
            bounds = np.searchsorted(keys, np.arange(len(example) + 1) << 32)
            most = int(np.diff(bounds).max())
            place = bounds[content][:, None] + np.arange(most)
            there = place < bounds[content + 1][:, None]
            image = np.where(there, images[np.minimum(place, len(keys) - 1)], -1)
            wanted = key(content[1:, None], np.maximum(image[:-1], 0))
            found = start_of(wanted)
            known = there[:-1] & (keys[found] == wanted)
            maps = np.full((len(lanes), most + 1), most, np.int64)
            maps[1:, :most] = np.where(known, found - bounds[content[1:]][:, None], most)
            entry = start_of(key(content[first], ends[lanes[first] - 1]))
            maps[first] = (entry - bounds[content[first]])[:, None]
            step = 1
            while step < len(lanes):  # after it, each map is composed of all before it in its run
                maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
                step *= 2
            at = maps[:, 0]
            if (at < most).all():
                return images[bounds[content] + at].astype(ends.dtype)
            # What each lane may begin in: the images of the lane before it that aren't start states yet.  Of known
            # states' images only those of the newest are new, so a round adds about one a lane, and none where states have merged.
            fresh = np.unique(wanted[there[:-1] & ~known & (np.isin(np.arange(1, len(lanes)), first, invert=True))[:, None]])

    def transitions(self, index: np.ndarray, out: np.ndarray) -> np.ndarray:
        """out, filled with the packed transitions at places (state * width + column); -1 where one isn't compiled."""
        self.table.reshape(-1).take(index, out=out, mode="clip")
        if len(index) and index.max() >= self.table.size:
            far = np.flatnonzero(index >= self.table.size)
            out[far] = [self.rare.get(i, -1) for i in index[far].tolist()]
        return out

    def pass_over(self, read, goes_on, taken, state, steps: int) -> None:
        index, wide = np.empty(len(state), np.int32), self.table.shape[1]
        for k in range(steps):
            np.multiply(state, goes_on[k], out=state)
            np.multiply(state, wide, out=index)
            np.add(index, read[k], out=index)
            got = self.transitions(index, taken[k])
            if got.min() < 0:
                for i in np.unique(index[got < 0]).tolist():
                    self.step(i // wide, self.byte[i % wide])
                self.transitions(index, got)
            np.right_shift(got, SHIFT, out=state)

    # -- texts -------------------------------------------------------------------------------------------------
    def prepared(self, data: np.ndarray, offsets: np.ndarray):
        """data's pre-token starts by byte, and the byte offsets of special tokens; offsets: where each text begins, and the end."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
        fresh_byte = np.zeros(len(data) + 1, bool)
        fresh_byte[offsets] = True
        specials, mark = [], SPECIAL.encode()
        if self.special is not None:
            where = raw.find(mark)
            while where >= 0:
                text = np.searchsorted(offsets, where, side="right")
                if where + len(mark) <= offsets[text]:
                    specials.append(where)
                    fresh_byte[[where, where + len(mark)]] = True
                    where = raw.find(mark, where + len(mark))
                else:  # it only seems to be one, across two texts
                    where = raw.find(mark, where + 1)
        starts = np.zeros(len(data), bool)
        if len(points):
            starts[lead] = self.boundaries(points, fresh_byte[lead])
        return starts, np.array(specials, np.int64)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text."""
        starts, specials = self.prepared(data, offsets)
        changes = (self.run(data, starts) & ((1 << SHIFT) - 1)) - BIAS
        for s in specials:
            changes[s : s + len(SPECIAL)] = 0
            changes[s] = 1
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(changes, out=total[1:], dtype=np.int64)
        return np.diff(total[offsets])

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin, and the end."""
        starts, specials = self.prepared(data, offsets)
        states = self.run(data, starts) >> SHIFT
        token = np.full(len(data), -1, np.int32)  # at its first byte
        begins = np.flatnonzero(starts)
        where = np.append(begins[1:], len(data)) - 1
        while len(where):  # backwards from the ends of pre-tokens, a token each at a time
            last = self.last[states[where]]
            begin = where - self.length[last] + 1
            token[begin] = last
            where = begin[~starts[begin]] - 1
        for s in specials:
            token[s : s + len(SPECIAL)] = -1
            token[s] = self.special
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(token >= 0, out=total[1:])
        return token[token >= 0].astype(np.uint32), total[offsets]


_COMPILED: dict[str, Transducer] = {}


def forget() -> None:
    """Gives up this process's transducers; a later one is compiled anew."""
    _COMPILED.clear()


def transducer(path: str) -> Transducer:
    """The transducer of a file, one for a process: what one batch compiles serves the next."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]
