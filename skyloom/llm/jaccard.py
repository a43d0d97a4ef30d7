"""Near-duplicate documents: an exact Jaccard self-join of word shingles, and the components of its links.

Documents with equal shingle sets are one node.  Shingles are ordered rarest first (by a sketch of bounded size
of their frequencies; any order gives right results), and only a node's prefix is shuffled.  Nodes that share a prefix
shingle first meet its centre alone, the node that has the fewest rarer shingles: that is the plainest of a group of near
copies, so that thousands of them make a star, not all pairs.  Then nodes of one shingle that still lie in different components meet each other.
Each pair passes length, positional and suffix filters where it is made, before it becomes a row; the suffix filter
compares parities: each node has PARITY bits, one for the parity of its shingles in each of as many buckets, and two sets differ in at
least as many shingles as their parities differ in bits.  What is left is verified once per pair on the whole shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketch
from .arrow import releasing
from .common import ship, written
from .components import components

SHINGLE = 5
#: A link: PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Needed texts are found by a broadcast of their keys up to so many bytes, and by a shuffle beyond.
BROADCAST_BYTES = 64 << 20
#: Bits of a node's parities; beyond some PARITY shingles in a set the suffix filter passes more and more, and drops no link.
PARITY = 1024
#: Rows of a shingle that one task gets; more are dealt by salts.
HOT_ROWS = 1024
#: Nodes of a shingle with more rows than this meet by the shingle's centre, once for all shingles of one centre, and pass the suffix filter inside the join; others make fewer rows than their parities would weigh, and pass it afterwards.
SMALL = 16


def shingle_sets(data, offsets, size: int = SHINGLE):
    """The distinct shingle hashes of each text, sorted, in a row, and where each text's begin, and the end.  A text of fewer words, but not none, has one: its whole sequence."""
    from .wordhash import U, Words, mixed

    words = Words(data, offsets, lower=True)
    keep = words.whole(size)
    hashes, text = words.windows(size)[keep], words.text_of[keep]
    counts = np.diff(words.first)
    for t in np.flatnonzero((counts > 0) & (counts < size)):
        h = np.full(1, counts[t], U)
        for k in range(words.first[t], words.first[t + 1]):
            h = mixed(h + words.hash[k : k + 1])
        hashes, text = np.append(hashes, h), np.append(text, t)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(len(offsets)))


def set_names(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name (int64) of each set: equal for equal sets."""
    from .wordhash import U, mixed

    total = np.zeros((2, len(hashes) + 1), U)
    np.cumsum(mixed(hashes + U(0x51ED270B)), out=total[0, 1:])
    np.cumsum(mixed(hashes ^ U(0xA5A5F00D12345678)), out=total[1, 1:])
    sums = total[:, at[1:]] - total[:, at[:-1]]
    return mixed(sums[0] ^ mixed(sums[1] + np.diff(at).astype(U))).view(np.int64)


def parities(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """PARITY bits of each set, as rows of 64-bit numbers."""
    m = len(at) - 1
    out = np.empty((m, PARITY // 8), np.uint8)
    bucket = (hashes & np.uint64(PARITY - 1)).astype(np.int64)
    for k in range(0, m, 1024):  # bounded memory for many short texts
        e = min(k + 1024, m)
        own = np.repeat(np.arange(e - k), np.diff(at[k : e + 1])) * PARITY + bucket[at[k] : at[e]]
        odd = np.bincount(own, minlength=(e - k) * PARITY).astype(np.uint8) & 1
        out[k:e] = np.packbits(odd.reshape(e - k, PARITY), axis=1)
    return out.view("<i8")


def nodes_and_sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n, node and parities of every document, and (block, counts) rows that sum to the sketch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("parity", T.ArrayType(T.LongType()))]
        + [T.StructField("block", T.IntegerType()), T.StructField("counts", T.BinaryType())]
    )
    kinds = to_arrow_schema(schema)

    def run(batches):
        from .arrow import SMALL_BYTES, slices

        counts = np.zeros(1 << sketch.BITS, np.int64)
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(2), SMALL_BYTES):
                hashes, at = shingle_sets(data, offsets, size)
                sketch.count(counts, hashes)
                m, wide = end - first, PARITY // 64
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * wide), pa.array(parities(hashes, at).reshape(-1)))
                found = [*(batch.column(k).slice(first, m) for k in (0, 1)), pa.array(np.diff(at)), pa.array(set_names(hashes, at)), lists, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(found, kinds, strict=True)], names=kinds.names)
        if counts.any():
            k = sketch.BLOCKS
            yield pa.RecordBatch.from_arrays([*(pa.nulls(k, f.type) for f in list(kinds)[:5]), pa.array(range(k), pa.int32()), pa.array(sketch.packed(counts), pa.binary())], names=kinds.names)

    return docs.mapInArrow(releasing(run), schema)


def prefixes(docs: DataFrame, frequencies: np.ndarray, size: int, percent: int) -> DataFrame:
    """h, node, n, pos, salts: the rarest shingles of each node, as many as any set within the limit must share one of; salts: into how many parts the rows of h should be dealt."""
    shared = docs.sparkSession.sparkContext.broadcast((frequencies, salts_of(frequencies)))

    def run(batches):
        from .arrow import SMALL_BYTES, slices

        rank_of, salts = shared.value
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0), SMALL_BYTES):
                hashes, at = shingle_sets(data, offsets, size)
                names = set_names(hashes, at)
                sizes = np.diff(at)
                once = np.zeros(len(names), bool)
                once[np.unique(names, return_index=True)[1]] = True
                take = np.where(once & (sizes > 0), sizes - -(-sizes * percent // 100) + 1, 0)
                rank = rank_of[sketch.buckets(hashes)]
                text = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((hashes, rank, text))
                pos = np.arange(len(hashes)) - np.repeat(at[:-1], sizes)
                chosen = pos < np.repeat(take, sizes)
                h, t, p = hashes[order][chosen], text[chosen], pos[chosen]
                columns = [h.view(np.int64), names[t], sizes[t].astype(np.int64), p.astype(np.int64), salts[rank[order][chosen]]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "node", "n", "pos", "salts"])

    return docs.select("text").mapInArrow(releasing(run), "h long, node long, n long, pos long, salts int")


def salts_of(frequencies: np.ndarray) -> np.ndarray:
    """The number of salts by a shingle's rank: one part for every HOT_ROWS that its bucket has beyond twice the mean."""
    count = 2 ** (np.arange(256) / 8) - 1
    mean = float(count[frequencies].mean()) if len(frequencies) else 0.0
    return np.maximum(1, np.ceil((count - 2 * mean) / HOT_ROWS)).clip(1, 1 << 20).astype(np.int32)


def met_rows(rows: DataFrame, percent: int) -> DataFrame:
    """h, node, n, pos, centre (struct of pos, node, n) of the rows whose shingle another node has too, at a place where both can be within the limit.

    By the length and positional filters, sets of n_a and n_b whose first common shingles are at i and j need
    n_b <= n_a * room(i / n_a) and n_a <= n_b * room(j / n_b), so the product of both rooms is at least 1: a row goes if
    its room is too small for the largest of its shingle.
    """
    salt = F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt")
    part = Window.partitionBy("h", "salt")
    centre, first = F.min(F.struct("pos", "node", "n")), F.min(F.col("pos") / F.col("n"))
    room = lambda place: 100 / percent - (100 + percent) / percent * place
    fits = room(F.col("pos") / F.col("n")) * room(F.col("first")) >= 1 - 1e-9
    seen = rows.select("*", salt).withColumns({"centre": centre.over(part), "lo": F.min("node").over(part), "hi": F.max("node").over(part), "first": first.over(part)})
    seen = written(seen.where((F.col("salts") > 1) | ((F.col("lo") != F.col("hi")) & fits)).select("h", "node", "n", "pos", "centre", "salts"), "met")
    hot = seen.where("salts > 1")
    whole = hot.groupBy("h").agg(F.min("centre").alias("centre"), F.min("node").alias("lo"), F.max("node").alias("hi"), first.alias("first")).where("lo <> hi").select("h", "centre", "first")
    dealt = hot.drop("centre").join(whole, "h").where(fits)  # parts meet again, a hot shingle's rows in as many tasks as AQE likes
    names = ["h", "node", "n", "pos", "centre"]
    return seen.where("salts = 1").select(names).unionByName(dealt.select(names))


def possible(n_a, i, n_b, j, percent: int):
    """Length and positional filters: can sets of n_a and n_b be within the limit if their first common shingles are at i and j?"""
    most = F.least(n_a - i, n_b - j)
    # intersection >= percent / (100 + percent) * (n_a + n_b)
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * most >= percent * (n_a + n_b))


def differing(a, b, n_a, n_b, percent: int):
    """Suffix filter: can sets of n_a and n_b with parities a and b be within the limit?"""
    bits = F.lit(0)
    for k in range(PARITY // 64):
        bits = bits + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
    # The limit holds exactly if the sets differ in (100 - percent) / (100 + percent) * (n_a + n_b) shingles at most.
    return (100 + percent) * bits <= (100 - percent) * (n_a + n_b)


def close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (columns a, b: nodes) that pass the suffix filter; nodes: node, n, parity."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.where(differing(F.col("parity_a"), F.col("parity_b"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of pairs (columns a, b: nodes) whose sets are within the limit; nodes: node, owner, owner_key."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    needed = written(ends.join(nodes, "node").select(F.col("node").alias("of_node"), F.col("owner").alias("of_doc"), F.col("owner_key").alias("of_key")), "needed")
    weight = needed.agg(F.sum(F.coalesce(F.octet_length(F.col("of_doc").cast("string")), F.lit(0)) + 48)).first()[0] or 0
    found = docs.join(F.broadcast(needed) if weight <= BROADCAST_BYTES else needed, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_key"))).select("of_node", "text")

    def own(batches):
        """The sorted set of each node; drops other texts of a chance equal key."""
        from .arrow import SMALL_BYTES, slices

        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1), SMALL_BYTES):
                hashes, at = shingle_sets(data, offsets, size)
                part = batch.slice(first, end - first)
                sets = [hashes[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["node", "shingles"]).filter(pa.array(set_names(hashes, at) == part.column(0).to_numpy()))

    sets = written(found.mapInArrow(releasing(own), "node long, shingles binary").dropDuplicates(["node"]), "sets")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"shingles_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "shingles_a", "shingles_b")
    return written(both.mapInArrow(releasing(check), "a long, b long"), "links")


def with_root(rows: DataFrame, node: str, name: str, roots: DataFrame) -> DataFrame:
    """rows with the root of a node as one more column; a node without links is its own."""
    found = roots.select(F.col("u").alias("__u"), F.col("root").alias("__root"))
    return rows.join(found, F.col(node) == F.col("__u"), "left").withColumn(name, F.coalesce("__root", node)).drop("__u", "__root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component of every row of docs: component is the least id that links reach, itself included.

    Two rows link when 100 * intersection >= percent * union of their shingle sets.  A null or empty text, or one without
    words, has an empty set and links with nothing (its component is its own id).  Equal rows link; rows of one id
    with different texts are judged apart.  Null ids never name a component that has other ids.  Other
    columns are not read; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("binary")).alias("text_key"), F.col(text_col).cast("binary").alias("text"))
    first = written(nodes_and_sketch(docs, size), "nodes")
    rows = first.where("block is null").select("doc_id", "n", "node")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    by_node = first.where("block is null and n > 0").groupBy("node").agg(least.alias("least"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    nodes = written(by_node.select("node", "n", "parity", F.col("least.doc_id").alias("owner"), F.col("least.text_key").alias("owner_key")), "owners")
    frequencies = sketch.summed(first.where("block is not null"), lambda x: np.round(8 * np.log2(1 + x)).clip(0, 255))
    met = met_rows(prefixes(docs, frequencies, size, percent), percent)
    star = (F.col("node") != F.col("centre.node")) & possible(F.col("n"), F.col("pos"), F.col("centre.n"), F.col("centre.pos"), percent)
    pairs = met.where(star).select(F.col("centre.node").alias("a"), F.col("node").alias("b")).distinct()
    star_pairs = written(close(pairs, nodes, percent), "pairs")
    roots = components(verified(star_pairs, docs, nodes, size, percent).toDF("u", "v"))
    placed = written(with_root(met.withColumn("centre", F.col("centre.node")), "node", "root", roots), "placed")
    split = placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("many")).where("lo <> hi").select("h", "many")
    apart = written(placed.join(split, "h"), "apart")
    # Two nodes of a shingle share its centre; the least place is the loosest bound.
    by_centre = apart.where(F.col("many") > SMALL).groupBy("centre", "node").agg(F.min("pos").alias("pos"), F.first("n").alias("n"), F.first("root").alias("root"))
    large = written(by_centre.join(nodes.select("node", "parity"), "node"), "large")

    def crossing(rows: DataFrame, key: str, *more: str) -> DataFrame:
        one, other = (rows.select(key, *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "pos", "root", *more)]) for x in ("a", "b"))
        here = lambda c: (F.col(f"{c}_a"), F.col(f"{c}_b"))
        near = possible(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"), percent)
        for c in more:
            near = near & differing(*here(c), *here("n"), percent)
        met = one.join(other, (one[key] == other[key]) & (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & near)
        return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("root_a").alias("ra"), F.col("root_b").alias("rb")).distinct()

    small = written(crossing(apart.where(F.col("many") <= SMALL), "h"), "small")
    passed = small.join(close(small.select("a", "b"), nodes, percent), ["a", "b"]).select("a", "b", "ra", "rb")
    either = star_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))  # tried and apart
    rest = written(passed.unionByName(crossing(large, "centre", "parity")).distinct().join(either, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        links = verified(rest.select("a", "b"), docs, nodes, size, percent).join(rest, ["a", "b"]).select(F.col("ra").alias("u"), F.col("rb").alias("v")).distinct()
        # Old components enter as stars around their roots.
        roots = components(roots.where("u <> root").select("u", F.col("root").alias("v")).unionByName(links))
    labels = nodes.join(roots, F.col("node") == F.col("u"), "left").select("node", F.coalesce("root", "node").alias("root"), "owner")
    names_of = labels.groupBy("root").agg(F.min("owner").alias("component"))
    of_node = labels.join(names_of, "root").select(F.col("node").alias("of_node"), "component")
    return rows.join(of_node, F.when(F.col("n") > 0, F.col("node")) == F.col("of_node"), "left").select(F.col("doc_id").alias("id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component"))
