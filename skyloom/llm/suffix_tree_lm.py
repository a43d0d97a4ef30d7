"""A probabilistic suffix tree over words, learnt from all training documents, and scores of texts under it.

Contexts are the last one to DEPTH words.  A context is learnt from the continuations that are found least_count(tokens) times:
that grows slower than the corpus, so a larger corpus gives a wider and deeper tree, of at most tokens / least_count(tokens)
entries a level, which is the bound of what is broadcast: it grows as the corpus to the power of 1/3.  Sketches of the pairs' and triples' counts, summed over all tasks, show first which can reach the
count; longer ones are tried where all triples in them can; what is left is counted exactly.  A
context is retained if its distribution diverges from its longest retained suffix's by more than GAIN, in nats over all its
occurrences.  Listed continuations are discounted, and what that frees goes to the shorter suffix, down to smoothed
word frequencies.  Rare words are looked up by a shuffle; the others are few enough to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import ship, written

P_WORD = 5e-7
#: The words of the longest context; a continuation counts from SHARE times all training tokens to the power of 2/3 on.
DEPTH, SHARE = 5, 2.5e-4
DISCOUNT, GAIN = 0.5, 10.0
#: Levels that have a sketch.
SKETCHED = 2
END = 0x7F4A7C15E3D5A7B1
#: Distinct words that a task holds before it passes them on.
HELD = 2_000_000


def symbols(data: np.ndarray, offsets: np.ndarray):
    """The hash of each word (A-Z in lower case) and of each text's end, and where each text's begin, and the end."""
    from .wordhash import U, Words

    words = Words(data, offsets, lower=True)
    at = words.first + np.arange(len(words.first))
    out = np.empty(at[-1], U)
    ends = at[1:] - 1
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body], out[ends] = words.hash, U(END)
    return out, at


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    from .wordhash import U, mixed

    return mixed(a * U(0xC2B2AE3D27D4EB4F) + b)


def grams(h: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The hashes of the 1, 2, ... DEPTH + 1 symbols that end at each symbol (those that begin before the text mean nothing), and each symbol's place in its text."""
    out = [h]
    for _ in range(DEPTH):
        before = np.zeros(len(h), h.dtype)
        before[1:] = out[-1][:-1]
        out.append(pair(before, h))
    return out, np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))


def least_count(tokens: int) -> int:
    return max(2, int(np.ceil(SHARE * tokens ** (2 / 3))))


def sketch_bits(tokens: int) -> int:
    """Buckets enough that few of them reach the least count by chance."""
    return int(np.clip(np.ceil(np.log2(4 * max(1, tokens) / least_count(tokens))), sketch.BITS, 27))


class Lookup:
    """Places of keys in a sorted array: -1 where there is none."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = np.zeros(1 << 22, bool)
        self.table[(keys >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), -1, np.int64)
        maybe = np.flatnonzero(self.table[(wanted >> np.uint64(42)).astype(np.int64)])
        if len(maybe) and len(self.keys):
            w = wanted[maybe]
            k = np.searchsorted(self.keys, w).clip(max=len(self.keys) - 1)
            found = self.keys[k] == w
            out[maybe[found]] = k[found]
        return out


@dataclass
class Level:
    """One length of contexts: of the retained ones the log10 of what goes to the shorter suffix, and of their listed continuations the log10 probability."""

    contexts: np.ndarray
    rest: np.ndarray
    entries: np.ndarray
    logs: np.ndarray


@dataclass
class Model:
    total: int
    scale: float
    words: np.ndarray
    counts: np.ndarray
    levels: list


def word_counts(train: DataFrame, bits: int) -> DataFrame:
    """(h, c) rows that sum to the words' counts, and (level, block, counts) rows that sum to the sketches."""

    def run(batches):
        from .arrow import slices

        sketches = [np.zeros(1 << bits, np.uint32) for _ in range(SKETCHED)]
        held, size, any_text = [], 0, False

        def passed_on():
            h, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            c = np.bincount(back, np.concatenate([y for _, y in held])).astype(np.int64)
            none = lambda kind: pa.nulls(len(h), kind)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), none(pa.int32()), none(pa.int32()), none(pa.binary())], ["h", "c", "level", "block", "counts"])

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                any_text = True
                h, at = symbols(data, offsets)
                of, order = grams(h, at)
                for level in range(SKETCHED):
                    bucket, c = np.unique(sketch.buckets(of[level + 1][order > level], bits), return_counts=True)
                    sketches[level][bucket] += c.astype(np.uint32)
                held.append(np.unique(h, return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    yield passed_on()
                    held, size = [], 0
        if held:
            yield passed_on()
        for level, counts in enumerate(sketches):
            if any_text:
                k = sketch.BLOCKS
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([level] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(sketch.packed(counts), pa.binary())], ["h", "c", "level", "block", "counts"])

    return train.select("text").mapInArrow(run, "h long, c long, level int, block int, counts binary")


def continuations(train: DataFrame, frequent: np.ndarray, likely: list[np.ndarray], bits: int) -> DataFrame:
    """(level, context, next, c) rows that sum to the counts of continuations that can reach the limit."""
    shared = train.sparkSession.sparkContext.broadcast((frequent, likely))

    def run(batches):
        from .arrow import slices

        frequent, likely = shared.value
        known = Lookup(frequent)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                h, at = symbols(data, offsets)
                of, order = grams(h, at)
                take = known(h) >= 0
                for level in range(DEPTH):
                    # A gram is found no more often than the two that it has inside.
                    both = np.zeros(len(h), bool)
                    both[1:] = take[1:] & take[:-1]
                    take = both & (order > level)
                    if level < SKETCHED:
                        idx = np.flatnonzero(take)
                        take[idx] = likely[level][sketch.buckets(of[level + 1][idx], bits)].astype(bool)
                    where = np.flatnonzero(take)
                    if not len(where):
                        break
                    _, first, c = np.unique(of[level + 1][where], return_index=True, return_counts=True)
                    context, after = of[level][where - 1][first], h[where][first]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), level, np.int32)), pa.array(context.view(np.int64)), pa.array(after.view(np.int64)), pa.array(c.astype(np.int64))], ["level", "context", "next", "c"])

    return train.select("text").mapInArrow(run, "level int, context long, next long, c long")


def grown(total: int, scale: float, words: np.ndarray, counts: np.ndarray, found: list[tuple]) -> Model:
    """The tree; found: for each level (context, next, count), arrays of one length."""
    model = Model(total, scale, words, counts, [])
    place = Lookup(words)
    of_context = (words, counts)  # how often each context occurs
    suffixes: list[tuple] = []  # for each level the grams' names, sorted, and what is left of each without its first word
    for level, (context, after, c) in enumerate(found):
        if not len(context):
            break
        order = np.argsort(context, kind="stable")
        context, after, c = context[order], after[order], c[order].astype(float)
        heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        own = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(context))))
        k = Lookup(of_context[0])(context[heads])
        n = np.where(k >= 0, of_context[1][k], 0).astype(float)
        # The shorter suffix's view of the continuation: all shorter contexts, the last word first.
        shorter = [context]
        for names, rest in reversed(suffixes):
            shorter.insert(0, rest[Lookup(names)(shorter[0])])
        base = 10 ** scored(model.levels, after, shorter[:-1], np.log10((counts[place(after)] + 0.5) / scale))
        listed = (c - DISCOUNT) / n[own]
        sums = lambda x: np.bincount(own, x, len(heads))  # noqa: E731, B023
        free, left = 1 - sums(listed), 1 - sums(base)
        rest = np.maximum(free, 1e-9) / np.maximum(left, 1e-9)
        gain = sums(c * np.log(listed / base)) + (n - sums(c)) * np.log(rest)
        keep = gain > GAIN
        names = pair(context, after)
        entry = names[keep[own]]
        turn = np.argsort(entry)
        model.levels.append(Level(context[heads][keep], np.log10(rest[keep]), entry[turn], np.log10(listed[keep[own]])[turn]))
        turn = np.argsort(names)  # this level's grams are the next one's contexts
        of_context = (names[turn], c[turn])
        left_over = after if not level else pair(shorter[-2], after)
        suffixes.append((names[turn], left_over[turn]))
    return model


def scored(levels: list[Level], after: np.ndarray, before: list, logs: np.ndarray) -> np.ndarray:
    """log10 probabilities of symbols: logs without context, then by each level's context (before: one array for each level) where it is retained."""
    for level, context in zip(levels, before, strict=False):
        k = Lookup(level.contexts)(context)
        entry = np.full(len(after), -1, np.int64)
        some = np.flatnonzero(k >= 0)
        entry[some] = Lookup(level.entries)(pair(context[some], after[some]))
        logs = np.where(k < 0, logs, np.where(entry >= 0, level.logs[entry] if len(level.logs) else 0, logs + (level.rest[k] if len(level.rest) else 0)))
    return logs


def local_scores(docs: DataFrame, model: Model) -> DataFrame:
    """key, h, n_tokens, n_known, base, score: one row for each document (n_tokens set) with what its broadcast words and contexts give, and one for each occurrence of another word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from .arrow import slices

        model = shared.value
        place = Lookup(model.words)
        word_logs = np.log10((model.counts + 0.5) / model.scale)
        finders = [(Lookup(x.contexts), Lookup(x.entries), x) for x in model.levels]
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for first, end, data, offsets in slices(batch.column(1)):
                h, at = symbols(data, offsets)
                k = place(h)
                known = k >= 0
                base = np.where(known, word_logs[k] if len(word_logs) else 0, 0.0)
                score = base.copy()
                of, order = grams(h, at)
                for d, (in_contexts, in_entries, level) in enumerate(finders):
                    where = np.flatnonzero(order > d)
                    c = in_contexts(of[d][where - 1])
                    some = np.flatnonzero(c >= 0)
                    w = where[some]
                    e = in_entries(of[d + 1][w])
                    score[w] = np.where(e >= 0, level.logs[e] if len(level.logs) else 0, score[w] + level.rest[c[some]])
                sums = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731, B023
                own = keys[first:end]
                m = len(own)
                rare = np.flatnonzero(~known)
                text = np.searchsorted(at, rare, side="right") - 1
                # A document's own row has a key that no word shares but by chance, which its missing count makes harmless.
                columns = [
                    np.concatenate([own, own[text]]),
                    np.concatenate([own ^ np.int64(0x5DEECE66D), h[rare].view(np.int64)]),
                    pa.array(np.concatenate([np.diff(at), np.zeros(len(rare), np.int64)]), mask=np.arange(m + len(rare)) >= m),
                    np.concatenate([sums(known.astype(np.int64)), np.zeros(len(rare), np.int64)]),
                    np.concatenate([sums(base), np.zeros(len(rare))]),
                    np.concatenate([sums(score), np.zeros(len(rare))]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x) if not isinstance(x, pa.Array) else x for x in columns], ["key", "h", "n_tokens", "n_known", "base", "score"])

    return docs.select("key", "text").mapInArrow(run, "key long, h long, n_tokens long, n_known long, base double, score double")


def learnt(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the table (h, c) of all words' counts; train: text (binary)."""
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(size // 6)  # about six bytes a word; only how well the sketches sort out depends on it
    parts = written(word_counts(train, bits), "words")
    vocabulary = written(parts.where("h is not null").groupBy("h").agg(F.sum("c").alias("c")), "vocabulary")
    row = vocabulary.agg(F.sum("c"), F.count(F.lit(1))).first()
    total, distinct = row[0] or 0, row[1]
    scale = total + 0.5 * (distinct + 1)
    least = least_count(total)
    found = vocabulary.where(F.col("c") >= max(1, min(least, P_WORD * total))).toArrow()  # at most 1 / P_WORD, or total / least rows
    words, counts = found.column("h").to_numpy().view(np.uint64), found.column("c").to_numpy()
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    likely = [sketch.summed(parts.where(F.col("level") == k), lambda x: x >= least, bits) for k in range(SKETCHED)]
    rows = continuations(train, words[counts >= least], likely, bits).groupBy("level", "context", "next").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    counted = written(rows, "continuations")
    grams_of = []
    for k in range(DEPTH):
        mine = counted.where(F.col("level") == k).select("context", "next", "c").toArrow()  # at most total / least rows
        grams_of.append((mine.column("context").to_numpy().view(np.uint64), mine.column("next").to_numpy().view(np.uint64), mine.column("c").to_numpy()))
    return grown(total, scale, words, counts, grams_of), vocabulary


def lm_scores(docs: DataFrame, held_out: str = "pmod(crc32(cast(doc_id as string)), 5) = 1") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row of docs (columns doc_id and text).

    held_out is an SQL condition on doc_id: such rows are scored and not learnt from; a null id is learnt from.  A null or empty text is its
    end alone.  Rows that repeat an id and its text are each learnt from and have equal scores; rows with one id and
    different texts are scored apart.  Other columns are not read.  Without training rows every word is unknown.
    """
    ship(docs.sparkSession)
    text = F.col("text").cast("binary")
    train = docs.where(~F.coalesce(F.expr(held_out), F.lit(False))).select(text.alias("text"))
    model, vocabulary = learnt(train)
    key = F.xxhash64("doc_id", "text")
    rows = local_scores(docs.select(key.alias("key"), text.alias("text")), model)
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(model.scale))
    rare = F.col("n_tokens").isNull()
    sums = (
        rows.join(vocabulary, "h", "left")
        .groupBy("key")
        .agg(
            F.count("n_tokens").alias("copies"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.when(rare, F.col("c").isNotNull().cast("long")).otherwise(F.col("n_known"))).alias("n_known"),
            F.sum(F.when(rare, log).otherwise(F.col("base"))).alias("base"),
            F.sum(F.when(rare, log).otherwise(F.col("score"))).alias("score"),
        )
    )
    one = lambda c: F.col(c) / F.col("copies")
    named = docs.select(F.col("doc_id").alias("id"), key.alias("key"))
    return named.join(sums, "key").select(
        "id", one("n_tokens").cast("long").alias("n_tokens"), one("n_known").cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), one("base").alias("base_score"), one("score").alias("score")
    )
