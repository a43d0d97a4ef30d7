"""Substring dedup of words: documents are factored against blocks that index every window of the corpus.

Relative Lempel-Ziv parsing: a reference block indexes, with their positions, all windows whose anchors belong to it, of all
documents.  Documents come to a block as runs of windows, and each run is parsed greedily: where the index has a window a
second time, a factor begins there that points to that place, and it goes on as long as the text and the reference behind the
two places agree.  The windows over a factor's end are looked up again, as beginnings of the next factor.  Factors that
end at a run's border go on in another block: when a document's factors meet, sorted, those that touch are joined.
Words are compared by hashes: 64 bits of a window's anchor and 32 bits of the whole window.

Inside a few MB of text, runs that repeat as a whole are one factor each and only one of them travels, so a group of copies
that holds a third of all rows gives a block one run for each slice instead of one for each row.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks_for, ship, written

WINDOW, GRAM = 35, 8
SLICE = 4 << 20
FIELDS = ("anchors", "owners", "starts", "sizes", "settled", "hashes", "factors")
BLOCK_ROWS = "block int, anchors binary, owners binary, starts binary, sizes binary, settled binary, hashes binary, factors binary"


def index_rows(source: DataFrame, window: int, gram: int, blocks: int) -> DataFrame:
    """Packed runs by block; source: owner (long), text (binary).  factors: those settled already, as (owner, start, end)."""

    def run(batches):
        from .arrow import slices
        from .runs import U, expanded, groups, repeated, runs_of, sliding_min
        from .wordhash import Words

        for batch in batches:
            owners = batch.column(0).to_numpy()
            for first, end, data, offsets in slices(batch.column(1), SLICE):
                words = Words(data, offsets, lower=False)
                whole = words.whole(window)
                least = sliding_min(words.windows(gram, 0x8CB92BA72F3D8DD7), window - gram + 1)
                anchor = np.zeros(len(whole), U)
                anchor[: len(least)] = least
                hashes = (words.windows(window) >> U(32)).astype(np.uint32)
                at = np.flatnonzero(whole)
                text = words.text_of[at]
                where = at - words.first[text]
                anchor, hashes = anchor[at], hashes[at]
                begin, size = runs_of(anchor, text, window)
                if not len(begin):
                    continue
                owner, start = owners[first:end][text[begin]], where[begin].astype(np.int32)
                key = anchor[begin]
                # Runs that are equal as a whole within the slice: hashes of all their windows, summed in place.
                weight = (hashes.astype(U) + U(1)) * (U(2) * (np.arange(len(at)) - np.repeat(begin, size)).astype(U) + U(0x9E3779B97F4A7C15))
                name = np.add.reduceat(weight * U(0xC2B2AE3D27D4EB4F), begin) ^ size.astype(U)
                twice = repeated(name, key)
                # Each of them is a factor that points to the one before it in the slice, the first of them to the second.
                send, of = np.ones(len(begin), bool), np.arange(len(begin))
                if twice.any():
                    idx = np.flatnonzero(twice)
                    order = idx[np.lexsort((name[idx], key[idx]))]
                    send[order[1:]] = (name[order[1:]] != name[order[:-1]]) | (key[order[1:]] != key[order[:-1]])
                    of[order[1:]] = order[:-1]
                    first = np.flatnonzero(send[order])
                    of[order[first]] = order[first + 1]
                of = of[twice]
                factors = np.rec.fromarrays([owner[twice], start[twice], (start + size + window - 1)[twice].astype(np.int32), owner[of], start[of]], dtype=FACTOR)
                block = (key % U(blocks)).astype(np.int64)
                idx = np.flatnonzero(send)
                idx = idx[np.argsort(block[idx], kind="stable")]
                found = groups(block[idx])
                # Settled factors only pass through: any block will do.
                share = np.linspace(0, len(factors), len(found) + 1).astype(int)
                rows = []
                for k, (b, x, y) in enumerate(found):
                    own = idx[x:y]
                    rows.append((b, key[own].tobytes(), owner[own].tobytes(), start[own].tobytes(), size[own].astype(np.uint8).tobytes(), twice[own].tobytes(), hashes[expanded(begin[own], size[own])].tobytes(), factors[share[k] : share[k + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(zip(*rows, strict=True))], ["block", *FIELDS])

    return source.mapInArrow(run, BLOCK_ROWS)


FACTOR = [("owner", "<i8"), ("start", "<i4"), ("end", "<i4"), ("source", "<i8"), ("source_start", "<i4")]


def parsed(run: np.ndarray, begin: np.ndarray, size: np.ndarray, name: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of runs of windows, as (first window, last window, first window of the source).

    run: the runs to parse; run k's windows are begin[k] to begin[k] + size[k] - 1.  name: of each window, equal for equal
    ones; other: for each window another place of it, -1 where there is none.  All runs go forward one window at a time.
    """
    end_of = np.repeat(begin + size, size)  # by window
    at, stop = begin[run], (begin + size)[run]
    head, source = np.full(len(run), -1), np.full(len(run), -1)  # the open factor
    out: list[tuple] = []

    def close(which: np.ndarray) -> None:
        out.append((head[which], at[which] - 1, source[which]))
        head[which] = -1

    while len(at):
        ahead = source + at - head  # where the source goes on
        goes_on = head >= 0
        idx = np.flatnonzero(goes_on)
        goes_on[idx] = (ahead[idx] < end_of[source[idx]]) & (name[np.minimum(ahead[idx], len(name) - 1)] == name[at[idx]])
        close(np.flatnonzero((head >= 0) & ~goes_on))
        fresh = np.flatnonzero((head < 0) & (other[at] >= 0))
        head[fresh], source[fresh] = at[fresh], other[at[fresh]]
        at = at + 1
        done = at >= stop
        if done.any():
            close(np.flatnonzero(done & (head >= 0)))
            at, stop, head, source = at[~done], stop[~done], head[~done], source[~done]
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))


def factored(rows: DataFrame, window: int) -> DataFrame:
    """owner, start, end (words), source, source_start of every factor; each block holds its own index only."""

    def run(table: pa.Table) -> pa.Table:
        from .runs import U, expanded, repeated

        kinds = {"anchors": U, "owners": np.int64, "starts": np.int32, "sizes": np.uint8, "settled": np.bool_, "hashes": np.uint32, "factors": np.dtype(FACTOR)}
        got = {k: np.frombuffer(b"".join(table.column(k).to_pylist()), kind) for k, kind in kinds.items()}
        size = got["sizes"].astype(np.int64)
        begin = np.cumsum(size) - size
        found = [tuple(got["factors"][c] for c in ("owner", "start", "end", "source", "source_start"))]
        at = expanded(begin, size)
        of = np.repeat(np.arange(len(size)), size)
        # A cheap test of one number for each window first, then the exact one among those that pass.
        idx = np.flatnonzero(repeated(got["anchors"][of] ^ (got["hashes"].astype(U) * U(0x9E3779B97F4A7C15))))
        if len(idx):
            hashes, anchors = got["hashes"][idx], got["anchors"][of[idx]]
            order = np.lexsort((hashes, anchors))
            new = np.ones(len(idx), bool)
            new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (anchors[order[1:]] != anchors[order[:-1]])
            heads = np.flatnonzero(new)
            count = np.diff(np.append(heads, len(idx)))
            name, other = -1 - np.arange(len(at)), np.full(len(at), -1)
            name[idx[order]] = np.repeat(np.arange(len(heads)), count)
            # Every place of a window points to its first one, and the first one to the second.
            other[idx[order]] = np.where(np.repeat(count > 1, count), idx[order][np.repeat(heads, count)], -1)
            several = heads[count > 1]
            other[idx[order[several]]] = idx[order[several + 1]]
            todo = np.flatnonzero(np.bincount(of[other >= 0], minlength=len(size)).astype(bool) & ~got["settled"])
            a, b, source = parsed(todo, begin, size, name, other)
            place = got["starts"][of].astype(np.int64) + (at - begin[of])
            found.append((got["owners"][of[a]], place[a], place[b] + window, got["owners"][of[source]], place[source]))
        columns = [np.concatenate([f[k] for f in found]) for k in range(5)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        return pa.table({c: pa.array(x.astype(k.to_pandas_dtype()), k) for (c, _), x, k in zip(FACTOR, columns, kinds, strict=True)})

    return rows.groupBy("block").applyInArrow(run, "owner long, start int, end int, source long, source_start int")


def kept_words(docs: DataFrame) -> DataFrame:
    """id, n_words, n_removed, spans (removed words, start and end), kept (text); docs: id, text (binary), factors."""

    def run(batches):
        for batch in batches:
            out = []
            for text, factors in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                spans: list[list[int]] = []
                for s, e in sorted((f["start"], f["end"]) for f in factors or ()):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                at, kept = 0, []
                for s, e in spans:
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), [{"start": s, "end": e} for s, e in spans], b" ".join(kept)))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[k].decode() if k == 3 else o[k] for o in out], kind) for k, kind in enumerate(kinds)]], ["id", "n_words", "n_removed", "spans", "kept"])

    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    return docs.mapInArrow(run, T.StructType([docs.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", spans), T.StructField("kept", T.StringType())]))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id, n_words, n_removed, spans, kept of every row of docs.

    Removed are the words covered by a window of `window` words whose sequence also starts anywhere else, in the
    same text or another, so all copies go.  A null or empty text has no words.  Rows that repeat an id and its text are
    copies of each other; rows of one id with different texts are judged apart.  Other columns are not read; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    owner = F.xxhash64(F.col(id_col), F.col(text_col))
    source = docs.select(owner.alias("owner"), F.make_valid_utf8(F.col(text_col)).cast("binary").alias("text"))
    blocks = blocks_for(source)
    factors = written(factored(index_rows(source, window, gram, blocks), window), "factors")
    by_owner = factors.groupBy("owner").agg(F.collect_list(F.struct("start", "end")).alias("factors"))
    whole = docs.select(F.col(id_col).alias("id"), F.make_valid_utf8(F.col(text_col)).cast("binary").alias("text"), owner.alias("of_owner"))
    return kept_words(whole.join(by_owner, F.col("of_owner") == F.col("owner"), "left").select("id", "text", "factors"))


