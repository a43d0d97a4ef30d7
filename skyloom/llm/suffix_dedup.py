"""Substring dedup of bytes by suffix arrays of shards.

Texts that are whole copies of a lesser document's are settled first.  Every window of `window` bytes of the others has
an anchor, the least hash of the short grams in it, so equal windows meet under one anchor; neighbouring windows with one
anchor are a run.  Runs are first compared as wholes: all copies of a run but the least document's are settled, however
many there are.  A window of a run also contains what stands before its anchor's gram, or what stands behind it, as far as
half of the rest of a window; a side that no other document's run shares has no common window.  Only the windows of shared
sides are left, one copy of each run; their bytes go to shards by anchor and side, whose suffixes are sorted by induction,
and windows that share a prefix of `window` bytes with their neighbours in the order are one string.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import releasing, slices
from .common import BROADCAST_BYTES, ship, written

WINDOW, GRAM = 50, 16
#: A shard of the suffix sort has about so many bytes.
SHARD_BYTES = 2 << 20
#: So many bytes of text are hashed at a time: the arrays then stay in a core's cache.
HASHED_BYTES = 256 << 10
#: A block of runs comes from about so many bytes of text, and is dealt from so many at a time.
BLOCK_BYTES, DEALT_BYTES = 8 << 20, 8 << 20
#: Columns of packed runs, of the documents they follow each other in, and of spans.  at: from a run's start to its gram.
RUN = {"key": "<u4", "name": "<u8", "start": "<u4", "size": "u1", "at": "<u2", "left": "<u4", "right": "<u4"}
DOC = {"doc": "<i8", "tag": "<i4", "runs": "<u4"}
SPAN = {"doc": "<i8", "tag": "<i4", "start": "<i4", "end": "<i4"}
#: at of a run whose windows have their anchor at several places.
SEVERAL = 0xFFFF
FOUND = "doc long, tag int, start int, end int, anchor long"


def packed(table: dict[str, np.ndarray], kinds: dict[str, str]) -> bytes:
    """The columns of a table one behind the other, compressed; doc by its differences."""
    import zstandard

    columns = [np.diff(table[c], prepend=0) if c == "doc" else table[c] for c in kinds]
    return zstandard.compress(b"".join(x.astype(k).tobytes() for x, k in zip(columns, kinds.values(), strict=True)), 1)


def unpacked(parts: list[bytes], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """The columns of several packed tables."""
    import zstandard

    width, found = sum(np.dtype(k).itemsize for k in kinds.values()), {c: [np.zeros(0, k)] for c, k in kinds.items()}
    for part in parts:
        raw, at = zstandard.decompress(part), 0
        n = len(raw) // width
        for c, k in kinds.items():
            x = np.frombuffer(raw, k, n, at)
            at += x.nbytes
            found[c].append(np.cumsum(x) if c == "doc" else x)
    return {c: np.concatenate(x) for c, x in found.items()}


def side_of(window: int, gram: int) -> int:
    """So many bytes before its gram are in a window whose gram starts there or later; windows whose gram starts earlier have one more behind it."""
    return (window - gram) // 2


def windows_of(data: np.ndarray, gram: int, window: int):
    """The hash of the `gram` bytes (a power of two) from each byte on, a function that gives the hash of the `window` bytes from some bytes on, and the hash of so many bytes (a power of two) as fit a side, with their number; the last ones mean nothing."""
    from .wordhash import U, mixed

    n = len(data)
    h, spare = np.zeros(n + window, U), np.empty(n + window, U)
    h[:n] = data
    h += U(1)
    size, seed, side = 1, 0x9E3779B97F4A7C15, 1 << max(1, side_of(window, gram)).bit_length() - 1
    kept = {1: mixed(h[:n])} if 1 in (gram, side) else {}
    while 2 * size <= window:
        np.multiply(h[:-size], U(seed), out=spare[:-size])
        spare[:-size] += h[size:]
        spare[-size:] = h[-size:]
        h, spare = spare, h
        seed = (seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (2**64 - 1) | 1
        size *= 2
        if size in (gram, side):
            kept[size] = mixed(h[:n])
    return kept[gram], lambda at: mixed(h[at] * U(seed) + h[at + (window - size)]), kept[side], side


def runs_in(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """The runs of some texts: anchor, owner (the text's number) and the columns of RUN but for the key."""
    from .runs import U, runs_of, sliding_min
    from .wordhash import mixed

    count = (np.diff(offsets) - window + 1).clip(0)
    if not count.sum():
        return {c: np.zeros(0, k) for c, k in {"anchor": "<u8", "owner": "<i8", **RUN}.items() if c != "key"}
    grams, whole, beside, reach = windows_of(data, gram, window)
    windows = np.arange(count.sum()) + np.repeat(offsets[:-1] - (np.cumsum(count) - count), count)
    text = np.repeat(np.arange(len(count)), count)
    anchor = sliding_min(grams, window - gram + 1)[windows]
    begin, size = runs_of(anchor, text, 255)
    anchor, owner, place = anchor[begin], text[begin], windows[begin]
    # Windows at both ends and every `window` bytes between name the run's bytes; longer runs name two parts.
    name = whole(place) * U(0xC2B2AE3D27D4EB4F) + whole(place + size - 1) * U(0x165667B19E3779F9) + size.astype(U)
    for k in range(window, 255, window):
        more = size > k
        name[more] = name[more] * U(0x9FB21C651E98DF25) + whole(place[more] + k)
    # The first place of the anchor's gram is that of all windows of a run, if the last one still has it.
    near, at = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1), np.zeros(len(place), np.int64)
    for k in range(0, len(place), 1 << 11):
        part = slice(k, k + (1 << 11))
        at[part] = (near[place[part]] == anchor[part, None]).argmax(axis=1)
    side = side_of(window, gram)
    several = (at < size - 1) | (at >= SEVERAL) | (side < 1)
    before, behind = (place + at - side).clip(0), place + at + gram
    ends = lambda first, width: mixed(beside[first.clip(0, len(data) - 1)] * U(0x9FB21C651E98DF25) + beside[(first + width - reach).clip(0, len(data) - 1)]).astype(np.uint32)
    return {"anchor": anchor, "owner": owner, "name": name, "start": place - offsets[owner], "size": size, "at": np.where(several, SEVERAL, at), "left": ends(before, side), "right": ends(behind, side + 1)}


def dealt(parts: list[dict[str, np.ndarray]], window: int, blocks: int) -> pa.RecordBatch:
    """Packed runs by block, and spans that are settled among them; parts: as runs_in gives them, with doc, tag and an owner of their own."""
    from .runs import U, groups

    r = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    # Equal runs: those of other than the least document are settled.
    order = np.argsort(r["anchor"] ^ r["name"] * U(0x9E3779B97F4A7C15))
    k, n, d = r["anchor"][order], r["name"][order], r["doc"][order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])])
    settled = np.zeros(len(order), bool)
    settled[order] = d > np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1]
    spans = {c: r[c][settled] for c in ("doc", "tag", "start")} | {"end": (r["start"] + r["size"] + window - 1)[settled]}
    idx = np.flatnonzero(~settled)
    block = (r["anchor"][idx] % U(blocks)).astype(np.int64)
    turn = np.argsort(block, kind="stable")
    block, r = block[turn], {c: x[idx[turn]] for c, x in r.items()}
    r["key"] = r["anchor"] >> U(32)
    found, rows = groups(block), []
    # Settled spans only pass through: any block will do.
    share = np.linspace(0, len(spans["doc"]), len(found) + 1).astype(int)
    for k, (b, x, y) in enumerate(found):
        heads = x + np.flatnonzero(np.concatenate([[True], r["owner"][x + 1 : y] != r["owner"][x : y - 1]]))
        docs = {"doc": r["doc"][heads], "tag": r["tag"][heads], "runs": np.diff(np.append(heads, y))}
        rows.append((b, packed({c: r[c][x:y] for c in RUN}, RUN), packed(docs, DOC), packed({c: v[share[k] : share[k + 1]] for c, v in spans.items()}, SPAN)))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(zip(*rows, strict=True))], ["block", "runs", "docs", "spans"])


def run_rows(source: DataFrame, window: int, gram: int, blocks: int) -> DataFrame:
    """Packed runs by block, and spans that are settled on the way; source: doc (long), tag (int), text (binary)."""

    def run(batches):
        held, size, texts = [], 0, 0
        for batch in batches:
            docs, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, end, data, offsets in slices(batch.column(2), HASHED_BYTES):
                part = runs_in(data, offsets, window, gram)
                if len(part["owner"]):
                    held.append(part | {"doc": docs[first:end][part["owner"]], "tag": tags[first:end][part["owner"]], "owner": part["owner"] + texts})
                size, texts = size + len(data), texts + end - first
                if held and size >= DEALT_BYTES:
                    yield dealt(held, window, blocks)
                    held, size = [], 0
        if held:
            yield dealt(held, window, blocks)

    return source.mapInArrow(releasing(run), "block int, runs binary, docs binary, spans binary")


def of_several(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether rows of each row's keys (a 64-bit one, or two of 32 bits) have different documents."""
    key = keys[0] if len(keys) == 1 else keys[0].astype(np.uint64) << np.uint64(32) | keys[1]
    out = np.zeros(len(doc), bool)
    if len(doc):
        order = np.argsort(key)
        k, d = key[order], doc[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        heads = np.flatnonzero(new)
        out[order] = (np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads))[np.cumsum(new) - 1]
    return out


def compared(rows: DataFrame, window: int, gram: int = GRAM) -> DataFrame:
    """FOUND: spans to remove (anchor null), and of one copy of each run the windows (start and end of their bytes) that runs of other documents may have too, by anchor and side."""
    side = side_of(window, gram)

    def run(table: pa.Table) -> pa.Table:
        from .wordhash import U, mixed

        block = table.column("block")[0].as_py() if len(table) else 0
        get = lambda c, kinds: unpacked(table.column(c).to_pylist(), kinds)
        r, docs, spans = get("runs", RUN), get("docs", DOC), get("spans", SPAN)
        r |= {c: np.repeat(docs[c], docs["runs"]) for c in ("doc", "tag")}
        out = [(spans["doc"], spans["tag"], spans["start"], spans["end"], np.zeros(len(spans["doc"]), np.int64))]
        if len(r["key"]):
            order = np.argsort(r["key"].astype(U) << U(32) | r["name"] >> U(32))
            r = {c: x[order].astype(np.int64) if c in ("start", "size", "at") else x[order] for c, x in r.items()}
            new = np.concatenate([[True], (r["key"][1:] != r["key"][:-1]) | (r["name"][1:] != r["name"][:-1])])
            gone = r["doc"] > np.minimum.reduceat(r["doc"], np.flatnonzero(new))[np.cumsum(new) - 1]
            end = r["start"] + r["size"] + window - 1
            out.append((r["doc"][gone], r["tag"][gone], r["start"][gone], end[gone], np.zeros(gone.sum(), np.int64)))
            # Of a document's equal runs one is enough to compare, but each is removed: all go on.
            left = np.flatnonzero(~gone)
            left = left[of_several(r["doc"][left], r["key"][left].astype(U))]
            r = {c: x[left] for c, x in r.items()}
            several = np.isin(r["key"], r["key"][r["at"] == SEVERAL])
            # Windows whose gram has `side` bytes before it come first, the others behind them.
            before = (r["at"] - side + 1).clip(0, r["size"])
            for part, first, last in ((0, 0 * before, r["size"]), (1, 0 * before, before), (2, before, r["size"])):
                beside = (np.zeros(len(left), np.uint32), r["left"], r["right"])[part]
                some = np.flatnonzero((several if part == 0 else ~several) & (last > first))
                some = some[of_several(r["doc"][some], r["key"][some], beside[some])]
                anchor = mixed((r["key"][some].astype(U) << U(32) | beside[some]) + U((3 * block + part) * 0x9E3779B97F4A7C15 % 2**64)) | U(1)
                out.append((r["doc"][some], r["tag"][some], (r["start"] + first)[some], (r["start"] + last)[some] + window - 1, anchor.view(np.int64)))
        cols = [np.concatenate([np.asarray(o[k], np.int64) for o in out]) for k in range(5)]
        return pa.table({"doc": cols[0], "tag": pa.array(cols[1], pa.int32()), "start": pa.array(cols[2], pa.int32()), "end": pa.array(cols[3], pa.int32()), "anchor": pa.array(cols[4], mask=cols[4] == 0)})

    return rows.groupBy("block").applyInArrow(run, FOUND)


def ends_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many spans each row has, and all their starts and ends; column: lists of start << 32 | end, or null."""
    span = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), span >> 32, span & 0xFFFFFFFF


def pieces(docs: DataFrame) -> DataFrame:
    """anchor, doc, tag, start, bytes of every run; docs: doc, tag, text, anchors, runs (start << 32 | end, as many)."""

    def run(batches):
        names, kinds = ["anchor", "doc", "tag", "start", "bytes"], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            count, start, end = ends_of(batch.column(4))
            anchor = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            doc, tag = (np.repeat(batch.column(k).to_numpy(), count) for k in range(2))
            owner, texts = np.repeat(np.arange(len(count)), count).tolist(), batch.column(2).to_pylist()
            for k in range(0, len(start), 50_000):
                part = slice(k, k + 50_000)
                cut = [texts[o][a:b] for o, a, b in zip(owner[part], start[part].tolist(), end[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip((anchor[part], doc[part], tag[part], start[part].astype(np.int32), cut), kinds, strict=True)], names)

    return docs.mapInArrow(releasing(run), "anchor long, doc long, tag int, start int, bytes binary")


def sorted_shards(found: DataFrame, window: int, shards: int) -> DataFrame:
    """doc, tag, start, end of the spans that the suffix arrays of the shards show to be repeated."""

    def run(table: pa.Table) -> pa.Table:
        from .suffix_array import permuted_prefixes, suffix_array

        texts = table.column("bytes").to_pylist()
        doc, tag, start = (table.column(c).to_numpy() for c in ("doc", "tag", "start"))
        length = np.array([len(t) for t in texts])
        data = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8)
        begin = np.cumsum(length + 1) - length - 1
        symbols = data.astype(np.uint16) + 2
        symbols[begin + length] = 1
        symbols[-1] = 0
        order = suffix_array(symbols, window)
        shared = permuted_prefixes(data, order, window)
        piece = np.repeat(np.arange(len(texts)), length + 1)
        piece = np.append(piece, len(texts) - 1)
        inside = np.arange(len(data)) + window <= (begin + length)[piece]
        first = ~((shared[order] >= window) & inside[order] & np.concatenate([[False], inside[order[:-1]]]))
        heads = np.flatnonzero(first)
        least = np.minimum.reduceat(doc[piece[order]], heads)
        gone = np.zeros(len(data) + 1, bool)
        gone[order] = (doc[piece[order]] > np.repeat(least, np.diff(np.append(heads, len(order))))) & inside[order]
        edge = np.diff(np.concatenate([[False], gone]).astype(np.int8))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        p = piece[a]
        at = start[p] + a - begin[p]
        return pa.table({"doc": doc[p], "tag": pa.array(tag[p], pa.int32()), "start": pa.array(at.astype(np.int32)), "end": pa.array((at + (b - a) + window - 1).astype(np.int32))})

    return found.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")).applyInArrow(run, "doc long, tag int, start int, end int")


def kept_bytes(docs: DataFrame) -> DataFrame:
    """id, n_bytes, n_removed, spans (removed bytes), kept (bytes); docs: id, text, spans (start << 32 | end)."""

    def run(batches):
        for batch in batches:
            count, start, end = ends_of(batch.column(2))
            owner = np.repeat(np.arange(len(count)), count)
            order = np.lexsort((start, owner))
            owner, start, end = owner[order], start[order], end[order]
            # Spans that overlap or touch are one: a text's places are counted from beyond those of the texts before it.
            shift = owner * (int(end.max(initial=0)) + 2)
            most = np.maximum.accumulate(end + shift)
            new = np.ones(len(start), bool)
            new[1:] = (start + shift)[1:] > most[:-1]
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(start))[: len(heads)] - 1
            start, end, owner = start[heads], (most - shift)[tails], owner[heads]
            first = np.searchsorted(owner, np.arange(len(count) + 1))
            starts, ends = start.tolist(), end.tolist()
            sizes, kept = [], []
            for text, x, y in zip(batch.column(1).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                text = text or b""
                sizes.append(len(text))
                kept.append(b"".join(text[a:b] for a, b in zip([0, *ends[x:y]], [*starts[x:y], len(text)], strict=True)) if y > x else text)
            spans = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["start", "end"]))
            n = np.array(sizes, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(n - np.array([len(k) for k in kept], np.int64)), spans, pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "spans", "kept"])

    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    return docs.mapInArrow(releasing(run), T.StructType([docs.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", spans), T.StructField("kept", T.BinaryType())]))


def whole_copies(texts: DataFrame, window: int) -> DataFrame:
    """doc, tag, size of the texts, of a window at least, that are those of a lesser document as wholes, by their SHA-256; texts: doc, tag, size, sha."""
    some = texts.where(F.col("size") >= window)
    first = written(some.groupBy("sha").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("sha", "least"), "first")
    return some.join(F.broadcast(first) if 48 * first.count() <= BROADCAST_BYTES else first, "sha").where("doc > least").select("doc", "tag", "size")


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id, n_bytes, n_removed, spans, kept of every row of docs; ids are integers.

    Removed is each byte covered by a `window`-byte string that also starts in a row with a smaller id; the least id keeps
    all.  Null or empty texts have no bytes; a null id counts as the greatest.  Rows with one id don't remove each other's bytes, whatever
    their texts.  Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType not in (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()):
        raise ValueError(f"{id_col} must be an integer column: the least id keeps what others repeat")
    ship(spark)
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    tag = F.hash(text_col)
    text = F.col(text_col).cast("binary")
    source = docs.select(doc.alias("doc"), tag.alias("tag"), text.alias("text"))
    texts = written(source.select("doc", "tag", F.octet_length("text").alias("size"), F.unhex(F.sha2("text", 256)).alias("sha")), "texts")
    copies = written(whole_copies(texts, window), "copies")
    many, bytes_ = copies.agg(F.count("*"), F.sum("size")).first()
    singles = source.join(F.broadcast(copies) if 24 * many <= BROADCAST_BYTES else copies, ["doc", "tag"], "left_anti") if many else source
    left = (texts.agg(F.sum("size")).first()[0] or 0) - (bytes_ or 0)
    blocks = min((1 << 31) - 1, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-left // BLOCK_BYTES)))
    found = written(compared(run_rows(singles, window, gram, blocks), window, gram), "found")
    rest = found.where("anchor is not null")
    size = rest.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    span = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("end").cast("long"))
    spans = found.where("anchor is null").select("doc", "tag", span.alias("span")).unionByName(copies.select("doc", "tag", F.col("size").cast("long").alias("span")))
    if size:
        runs = rest.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", span.alias("span"))).alias("runs")).select("doc", "tag", F.col("runs.anchor").alias("anchors"), F.col("runs.span").alias("runs"))
        with_text = source.join(runs.hint("shuffle_hash"), ["doc", "tag"]).select("doc", "tag", "text", "anchors", "runs")
        repeated = written(sorted_shards(pieces(with_text), window, max(1, -(-size // SHARD_BYTES))), "sorted")
        spans = spans.unionByName(repeated.select("doc", "tag", span.alias("span")))
    by_doc = spans.groupBy("doc", "tag").agg(F.collect_list("span").alias("spans"))
    whole = docs.select(F.col(id_col).alias("id"), text.alias("text"), doc.alias("doc"), tag.alias("tag"))
    return kept_bytes(whole.join(by_doc.hint("shuffle_hash"), ["doc", "tag"], "left").select("id", "text", "spans"))
