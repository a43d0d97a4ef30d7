"""Source divergence: how far the term shares of each language's sources are from each other, and which terms set a source apart.

Groups are dealt into blocks that stay in their partitions; compressed vectors of the other blocks of a language come
round in the rounds of a round-robin tournament, and each meeting of two blocks gives the differences in both
directions.  A language's terms are dealt into shards first, so that a block has a bounded size whatever the vocabulary;
differences of shards add up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written

#: The least number of documents of a kept term, what is added to each count, the scale of a share, and the ranks of terms.
LEAST_DOCS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: At most so many blocks of a language meet, of at least so many groups each; a block's shard has about so many entries.
MOST_BLOCKS, LEAST_GROUPS, ENTRIES = 64, 4, 1 << 21
#: Rounds that one job runs: so many copies of the compressed vectors are on their way at once.
ROUNDS_A_JOB = 8
#: Bytes of text that are counted at once; a longer text alone.
SLICE_BYTES = 12 << 20
#: Bytes to terms: A-Z are lower-cased, other letters and all bytes of longer characters stay, the rest parts terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


# -- counts ----------------------------------------------------------------------------------------------------------
def slice_counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of texts (bytes, UTF-8) with the numbers of their groups: group, term, occurrences and documents of every group and term in them."""
    import pyarrow.compute as pc

    lowered = data.tobytes().translate(LETTERS)
    texts = pa.LargeStringArray.from_buffers(len(group), pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(lowered))
    split = pc.ascii_split_whitespace(texts)
    doc, terms = pc.list_parent_indices(split).to_numpy().astype(np.int64), split.values.dictionary_encode()
    size = max(1, len(terms.dictionary))

    def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each run of equal sorted keys begins, and its length."""
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return first, np.diff(np.r_[first, len(keys)])

    keys = np.sort(doc * size + terms.indices.to_numpy())
    first, n = runs(keys)
    keys = group[keys[first] // size] * size + keys[first] % size
    order = np.argsort(keys, kind="stable")
    first, n_docs = runs(keys[order])
    found = keys[order][first]
    n = np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)
    return found // size, terms.dictionary.take(pa.array(found % size)), n, n_docs


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, n_docs by group; a row with an empty term stands for the group itself.  Null lang, source or text is empty.  Counted by slices first; the shuffle's partitions add those up."""
    ship(docs.sparkSession)
    clean = lambda c: F.make_valid_utf8(F.coalesce(F.col(c).cast("string"), F.lit("")))

    def run(batches):
        from .arrow import slices
        from .divergence import SLICE_BYTES, slice_counts

        for batch in batches:
            pairs = pa.table([batch.column(0), batch.column(1)], ["lang", "source"])
            known = pairs.group_by(["lang", "source"]).aggregate([])
            number = {g: k for k, g in enumerate(zip(*(known.column(c).to_pylist() for c in ("lang", "source")), strict=True))}
            group = np.array([number[g] for g in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True)], np.int64)
            none = np.zeros(len(number), np.int64)
            found = [(np.arange(len(number)), pa.array([""] * len(number)), none, none)]
            found += [slice_counts(data, offsets, group[first:end]) for first, end, data, offsets in slices(batch.column(2), SLICE_BYTES)]
            for own, terms, n, n_docs in found:
                of_group = [known.column(c).combine_chunks().take(pa.array(own)) for c in ("lang", "source")]
                yield pa.RecordBatch.from_arrays([*of_group, terms.cast(pa.string()), pa.array(n, pa.int64()), pa.array(n_docs, pa.int64())], ["lang", "source", "term", "n", "n_docs"])

    source = docs.select(clean("lang").alias("lang"), clean("source").alias("source"), clean("text").alias("text"))
    parts = source.mapInArrow(run, "lang string, source string, term string, n long, n_docs long")
    # The slices' sums repeat too few keys for a second sum before the shuffle.
    return parts.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def kept_terms(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, term, total, shard, id: the terms of enough documents of a language; shards by hash, ids by UTF-8 order within a shard.  The more groups a block holds, the more shards."""
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= LEAST_DOCS).drop("n_docs")
    kept = written(kept, "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v")).join(groups.groupBy("lang").agg(F.count("*").alias("s")), "lang")
    sizes = sizes.select("lang", F.ceil(F.col("v") * groups_a_block() / ENTRIES).alias("shards"))
    dealt = kept.join(sizes, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), "shards").cast("int"))
    return written(dealt.withColumn("id", F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1).drop("shards"), "terms")


def groups_a_block():
    return F.greatest(F.lit(LEAST_GROUPS), F.ceil(F.col("s") / MOST_BLOCKS))


# -- vectors ---------------------------------------------------------------------------------------------------------
def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending ids as differences and counts, compressed."""
    import zstandard

    order = np.argsort(ids)
    return zstandard.compress(np.diff(ids[order], prepend=0).astype("<u4").tobytes() + counts[order].astype("<i8").tobytes(), 3)


def unpacked(vector: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    if vector is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = zstandard.decompress(vector)
    k = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", k).astype(np.int64)), np.frombuffer(raw, "<i8", k, 4 * k)


def share(counts: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(SCALE * (count + ADDED) / whole) in exact steps of a thousand, for whole up to 9e15."""
    rest, out = counts + ADDED, np.zeros(len(counts), np.int64)
    if not whole:
        return out
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def dense(row: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A group's counts and shares over all terms of a shard."""
    counts = np.zeros(size, np.int64)
    ids, n = unpacked(row["vector"])
    counts[ids] = n
    return counts, share(counts, row["whole"])


def vectors(counts: DataFrame, terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, shard, size (terms of the shard), whole (N + 5 V), vector: one row for each group and shard of its language (shard 0 where no term is kept), and one of null source for the language itself."""
    by_lang = terms.groupBy("lang", "shard").agg(F.count("*").alias("size"))
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    mine = counts.where("term <> ''").join(terms.select("lang", "term", "shard", "id"), ["lang", "term"]).select("lang", "source", "shard", "id", "n")
    every = mine.unionByName(terms.select("lang", F.lit(None).cast("string").alias("source"), "shard", "id", F.col("total").alias("n")))
    ship(counts.sparkSession)

    def pack(table: pa.Table) -> pa.Table:
        from .divergence import packed

        ids, n = (table.column(c).to_numpy() for c in ("id", "n"))
        return pa.table({**{c: table.column(c).slice(0, 1) for c in ("lang", "source", "shard")}, "vector": pa.array([packed(ids, n)], pa.binary()), "n_shard": pa.array([int(n.sum())], pa.int64())})

    found = written(every.groupBy("lang", "source", "shard").applyInArrow(pack, "lang string, source string, shard int, vector binary, n_shard long"), "vectors")
    wholes = found.groupBy("lang", "source").agg(F.sum("n_shard").alias("n"))
    rows = groups.select("lang", "source").unionByName(groups.select("lang").distinct().withColumn("source", F.lit(None).cast("string")))
    rows = rows.join(of_lang, "lang", "left").join(by_lang, "lang", "left").join(wholes.withColumnRenamed("lang", "l").withColumnRenamed("source", "s"), (F.col("lang") == F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")
    rows = rows.select("lang", "source", F.coalesce("shard", F.lit(0)).alias("shard"), F.coalesce("size", F.lit(0)).alias("size"), (F.coalesce("n", F.lit(0)) + ADDED * F.coalesce("v", F.lit(0))).alias("whole"))
    here = found.select(*(F.col(c).alias(f"f_{c}") for c in ("lang", "source", "shard")), "vector")
    return rows.join(here, (F.col("lang") == F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")) & (F.col("shard") == F.col("f_shard")), "left").drop("f_lang", "f_source", "f_shard")


# -- meetings --------------------------------------------------------------------------------------------------------
def seats(blocks):
    """Seats of the tournament (of a column or a number of blocks), which is also its number of rounds: odd, so with an even number of blocks one is empty.  In round t the block b meets (t - b) mod seats: symmetric, and each pair meets once."""
    return blocks + 1 - blocks % 2


LANGUAGE, VISITOR = 0, 1


def meet(left: pa.Table, right: pa.Table, home: bool) -> pa.Table:
    """What a resident block (left) has to say when peers (right) come: differences of its groups with each visitor in both directions; at home also those inside the block, and each group's heap of terms against the language's shares."""
    import heapq

    out: dict[str, list] = {c: [] for c in ("lang", "source", "other", "shard", "id", "value")}

    def tell(lang, source, other, shard, k, value):
        for c, x in zip(out, (lang, source, other, shard, k, value), strict=True):
            out[c].append(x)

    rows = left.to_pylist()
    if rows:
        lang, shard, size = rows[0]["lang"], rows[0]["shard"], rows[0]["size"]
        counts, shares = zip(*(dense(r, size) for r in rows), strict=True)
        matrix = np.stack(shares)

        def pairs(first: int, name: str, against: np.ndarray) -> None:
            """The differences of the resident groups from `first` on with a peer."""
            for r, value in zip(rows[first:], np.abs(matrix[first:] - against).sum(axis=1).tolist(), strict=True):
                tell(lang, r["source"], name, shard, None, value)
                tell(lang, name, r["source"], shard, None, value)

        for k, r in enumerate(rows if home else []):
            pairs(k + 1, r["source"], matrix[k])
        for batch in right.to_batches(max_chunksize=1):
            visitor = batch.to_pylist()[0]
            peer = dense(visitor, size)[1]
            if visitor["role"] == VISITOR:
                pairs(0, visitor["source"], peer)
                continue
            for r, mine, p in zip(rows, counts, matrix, strict=True):
                more = np.flatnonzero((mine > 0) & (p > peer))
                for value, k in heapq.nsmallest(TOP, zip((peer[more] - p[more]).tolist(), more.tolist(), strict=True)):
                    tell(lang, r["source"], None, shard, k, -value)
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())
    return pa.table({c: pa.array(x, kind) for (c, x), kind in zip(out.items(), kinds, strict=True)})


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank for docs (lang, source, text): part `pair` has each other source of the language with the sum of the terms' differences of shares, part `term` the TOP terms whose share is above the language's.

    Null lang, source and text are empty, and an empty lang or source is one like others; a group without kept terms
    takes part with the shares of no counts, and where a language keeps no term all its pairs have value 0.  Repeated
    rows and ids count as rows (ids and other columns aren't read).  Ties rank by the item's UTF-8.  A language of one
    source has no rows.  Bytes that aren't UTF-8 are U+FFFD, which parts no term.  An empty table gives no rows.

    Counts are summed in slices before the shuffle; a hot group is a few sums from each task.  Vectors are dealt into
    blocks and shards of about ENTRIES entries; resident blocks are repartitioned once and kept (a lost one is read
    again from the written table), and only compressed visitors are shuffled, ROUNDS_A_JOB rounds at a time.
    """
    spark = docs.sparkSession
    counts = written(term_counts(docs), "counts")
    groups = written(counts.where("term = ''").select("lang", "source"), "groups")
    numbered = groups.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    sizes = groups.groupBy("lang").agg(F.count("*").alias("s"))
    numbered = numbered.join(sizes, "lang").select("lang", "source", F.floor(F.col("k") / groups_a_block()).cast("int").alias("block"), F.ceil(F.col("s") / groups_a_block()).cast("int").alias("blocks"))
    terms = kept_terms(counts, groups)
    every = vectors(counts, terms, groups)
    mine = numbered.select(F.col("lang").alias("l"), F.col("source").alias("s"), "block", "blocks")
    table = written(every.join(mine, (F.col("lang") == F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s"), "blocks")
    groups_in = table.where("source IS NOT NULL")
    key = ["lang", "shard", "block"]
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    resident = groups_in.repartition(dealt, *key).persist(StorageLevel.DISK_ONLY)
    schema = "lang string, source string, other string, shard int, id int, value long"
    most = groups_in.agg(F.max("blocks")).first()[0] or 0
    said: list[DataFrame] = []
    try:
        for first in range(0, seats(most), ROUNDS_A_JOB):
            visitors = rounds(groups_in, first, ROUNDS_A_JOB)
            if not first:
                homes = groups_in.select(F.col("lang").alias("l"), F.col("shard").alias("sh"), "block").distinct()
                q = table.where("source IS NULL").drop("block", "blocks")
                visitors = visitors.unionByName(q.join(homes, (F.col("lang") == F.col("l")) & (F.col("shard") == F.col("sh"))).drop("l", "sh").withColumn("role", F.lit(LANGUAGE)))
            said.append(written(meetings(resident, visitors, key, not first, schema), "meetings"))
    finally:
        resident.unpersist()
    found = said[0]
    for more in said[1:]:
        found = found.unionByName(more)
    return ranked(found, terms)


def rounds(groups: DataFrame, first: int, n: int) -> DataFrame:
    """The visitors of n rounds from `first`: each group's vector with the block that it comes to.  Of two blocks that meet the lower one is at home."""
    turns = groups.withColumn("turn", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))))
    host = F.pmod(F.col("turn") - F.col("block"), seats(F.col("blocks")))
    visits = turns.where(F.col("turn") < seats(F.col("blocks"))).withColumn("host", host.cast("int")).where((F.col("host") < F.col("block")) & (F.col("host") < F.col("blocks")))
    return visits.select("lang", "source", "shard", "size", "whole", "vector", F.col("host").alias("block"), F.lit(VISITOR).alias("role"))


def meetings(resident: DataFrame, visitors: DataFrame, key: list[str], home: bool, schema: str) -> DataFrame:
    ship(resident.sparkSession)

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        from .divergence import meet

        return meet(left, right, home)

    visitors = visitors.select(*(F.col(c).alias(c) for c in visitors.columns))  # both sides come from one table: new columns tell them apart
    return resident.groupBy(*key).cogroup(visitors.groupBy(*key)).applyInArrow(met, schema)


def ranked(found: DataFrame, terms: DataFrame) -> DataFrame:
    """The shards' sums of pairs and the shards' heaps of terms, ranked by group."""
    by_group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = found.where("id IS NULL").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_group)).withColumn("part", F.lit("pair"))
    names = terms.select("lang", "shard", "id", F.col("term").alias("item"))
    best = found.where("id IS NOT NULL").join(names, ["lang", "shard", "id"]).select("lang", "source", "item", "value")
    best = best.withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= TOP).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(best.select(*columns))
