"""Many words at once: an automaton with failure links over all words of a dictionary reads each text once, whatever the number of words."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Characters of texts that are read at once.
CHUNK = 1 << 22
#: Characters of a piece: so many look-ups follow each other, over all pieces side by side.
PIECE = 256


class Automaton:
    """Goto, failure and output tables of a set of words, as arrays over the words' own characters; a character of no word leads to the root.

    State 0 is the root.  `step[state, symbol]` has the failure links worked in, so a text is one look-up a character;
    texts are read side by side, a column of characters at a time, so a look-up serves many texts.
    """

    def __init__(self, words: list[tuple[int, str]]):
        letters = sorted({c for _, w in words for c in w})
        self.symbol = np.zeros(0x110000, np.int16)
        self.symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        children: list[dict[int, int]] = [{}]
        ends: list[set[int]] = [set()]
        for value, word in words:
            at = 0
            for c in word:
                k = int(self.symbol[ord(c)])
                if k not in children[at]:
                    children[at][k] = len(children)
                    children.append({})
                    ends.append(set())
                at = children[at][k]
            if word:
                ends[at].add(value)
        self.step = np.zeros((len(children), len(letters) + 1), np.int32)
        fail, queue = [0] * len(children), [0]
        for at in queue:  # in order of depth: a failure link leads to a state that is done
            self.step[at] = self.step[fail[at]]
            for k, to in children[at].items():
                fail[to] = int(self.step[fail[at], k]) if at else 0
                ends[to] |= ends[fail[to]]
                self.step[at, k] = to
                queue.append(to)
        self.ends = [sorted(e) for e in ends]
        self.overlap = max([1, *(len(w) for _, w in words)]) - 1
        self.some = np.array([bool(e) for e in ends])

    def hits(self, texts: list[str]) -> list[list[int]]:
        """The values of the words of each text, each once, ascending.  Texts are read in pieces of PIECE characters, which overlap by the longest word but one character."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = self.symbol[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begins = np.cumsum(sizes) - sizes
        counts = np.maximum(1, -(-(sizes - self.overlap) // PIECE))
        owner = np.repeat(np.arange(len(texts)), counts)
        offset = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * PIECE
        length = np.minimum(PIECE + self.overlap, sizes[owner] - offset)
        order = np.argsort(-length, kind="stable")
        owner, starts, length = owner[order], (begins[owner] + offset)[order], length[order]
        seen, state, live = set(), np.zeros(len(order), np.int32), len(order)
        for place in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length[:live], -place, side="left"))
            state[:live] = self.step[state[:live], flat[starts[:live] + place]]
            rows = np.flatnonzero(self.some[state[:live]])
            seen.update(zip(owner[rows].tolist(), state[rows].tolist(), strict=True))
        found: list[set[int]] = [set() for _ in texts]
        for k, at in seen:
            found[k].update(self.ends[at])
        return [sorted(f) for f in found]


@functools.cache
def automaton(words: tuple[tuple[int, str], ...]) -> Automaton:
    return Automaton(list(words))


def found_words(text: Column, words: list[tuple[int, str]]) -> Column:
    """An array of the values of the words (value, word) that are in a text, ascending, each once; empty for null.  Words count literally, wherever they stand and whatever they overlap; an empty word is in no text."""
    shared = tuple(words)

    @F.arrow_udf("array<int>")
    def found(column: pa.Array) -> pa.Array:
        from skyloom.operators.words import CHUNK, automaton

        machine, out, part, size = automaton(shared), [], [], 0
        for t in column.to_pylist():
            part.append(t or "")
            size += len(part[-1])
            if size > CHUNK:
                out += machine.hits(part)
                part, size = [], 0
        return pa.array(out + machine.hits(part), pa.list_(pa.int32()))

    return found(text)


def may_have(text: Column, words: list[tuple[int, str]]) -> Column:
    """Whether a text has a character that a word begins with: a cheap test on the JVM that leaves few texts for the automaton where the words' script is rare.  Wide characters are tested as one range."""
    firsts = {w[0] for _, w in words if w}
    wide, plain = sorted(c for c in firsts if not c.isascii()), sorted(c for c in firsts if c.isascii())
    kind = "".join(f"\\x{{{ord(c):x}}}" for c in plain) + (f"\\x{{{ord(wide[0]):x}}}-\\x{{{ord(wide[-1]):x}}}" if wide else "")
    return text.rlike(f"[{kind}]") if kind else F.lit(False)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, for clusters whose workers cannot import it."""
    import atexit
    import os
    import shutil
    import tempfile

    sc = spark.sparkContext
    if getattr(sc, "_skyloom_sent", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="skyloom-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{folder}/skyloom", "zip", root, "skyloom"))
    sc._skyloom_sent = True
