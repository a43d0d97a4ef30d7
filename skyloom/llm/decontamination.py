"""Benchmark decontamination: hits of benchmark word windows in documents, found by one scan.

Words are hashed once each and windows are hashes of word hashes, which meet the distinct windows of the benchmark in a hash
join; only what meets is compared as words.  The benchmark side is broadcast below a checked number of bytes: there a marker row
that each document adds to its own windows passes the same join, so documents without hits need no second scan.
Beyond it the windows' hashes are shuffled (two of 64 bits, in place of the words), what meets is compared as words once the
documents that have any are joined, and documents without hits come from a second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii

WINDOW = 13
#: A document is contaminated from one hit word in so many words.
SHARE = 20
#: The benchmark's windows are broadcast up to so many bytes.
BROADCAST_BYTES = 64 << 20
OTHER = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
MARK = 0  # the marker's hash; its length, 0, is no window's


def normal_words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters a-z and characters beyond ASCII; none for null."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), OTHER), lambda w: w != "")


def hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def window_hash(hashes: Column, i: Column, n) -> Column:
    """A hash of the n words from i on (from 0), by their hashes."""
    return F.xxhash64(F.slice(hashes, i + 1, n))


def windows_of(hashes: Column, n: int) -> Column:
    """struct(pos, len, h) for each window of n words."""
    return F.when(
        F.size(hashes) >= n,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), window_hash(hashes, i, n).alias("h"))),
    ).otherwise(F.array().cast("array<struct<pos:int,len:int,h:bigint>>"))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """key, len, h, items: the distinct windows, their hashes and the sorted ids (as strings) of the items that have them.  An item of fewer words is one window; one without words has none; a null id counts as an empty string."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), normal_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    each = F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.struct(F.array_join(F.slice("w", i + 1, size), " ").alias("key"), window_hash(hashed(F.col("w")), i, size).alias("h")))
    every = items.select("item", size.alias("len"), F.explode(each).alias("at")).select("item", "len", "at.*")
    return every.groupBy("key", "len", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, share: int = SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of docs: id, n_words, hits (the disjoint word spans [start, end) of hit words, in order), n_hit, items, contaminated.

    A null or empty text has no words and no hits.  Rows that repeat an id and its text give as many equal
    results; rows with one id and different texts are judged apart.  An empty benchmark hits nothing.
    """
    wanted = benchmark_windows(benchmark, window=window)
    shape = wanted.agg(F.sum(F.octet_length("key") + 40 + 24 * F.size("items")).alias("bytes"), F.collect_set("len").alias("lens")).first()  # at most `window` lengths
    lens = sorted(shape["lens"] or [])
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), normal_words(F.col(text_col)).alias("w")).withColumn("hashes", hashed(F.col("w")))
    row = ["id", "text_key", "n_words"]
    windows = F.concat(*[windows_of(F.col("hashes"), n) for n in lens]) if lens else F.array().cast("array<struct<pos:int,len:int,h:bigint>>")
    counted = split.select("id", "text_key", F.size("w").cast("long").alias("n_words"), "w", windows.alias("windows"))
    known = wanted.select(F.col("h").alias("of_h"), F.col("len").alias("of_len"), "key", "items")
    if (shape["bytes"] or 0) <= broadcast_bytes:
        marker = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.lit(MARK).cast("long").alias("h")))
        mark = docs.sparkSession.createDataFrame([(MARK, 0, "", [])], "of_h long, of_len int, key string, items array<string>")
        scanned = counted.select(*row, "w", F.explode(F.concat(marker, "windows")).alias("at")).select(*row, "w", "at.*")
        same = (F.col("h") == F.col("of_h")) & (F.col("len") == F.col("of_len")) & ((F.col("len") == 0) | (F.array_join(F.slice("w", F.col("pos") + 1, F.col("len")), " ") == F.col("key")))
        found = scanned.join(F.broadcast(known.unionByName(mark)), same).select(*row, "pos", "len", "items")
    else:
        again = lambda words: F.xxhash64(words, F.lit("again"))
        with_second = F.transform("windows", lambda x: F.struct(x["pos"].alias("pos"), x["len"].alias("len"), x["h"].alias("h"), again(F.slice("w", x["pos"] + 1, x["len"])).alias("h2")))
        scanned = counted.select(*row, F.explode(with_second).alias("at")).select(*row, "at.*")
        other = known.select("of_h", "of_len", again(F.split("key", " ")).alias("of_h2"), "key", "items")
        met = scanned.join(other, (F.col("h") == F.col("of_h")) & (F.col("h2") == F.col("of_h2")) & (F.col("len") == F.col("of_len")))
        met = met.groupBy(row).agg(F.collect_set(F.struct("pos", "len", "key", "items")).alias("met"))
        # What met by hashes is compared as words, in the documents that have any.
        own = split.select(F.col("id").alias("of_id"), F.col("text_key").alias("of_text"), "w")
        same = F.col("id").eqNullSafe(F.col("of_id")) & F.col("text_key").eqNullSafe(F.col("of_text"))
        true = F.filter("met", lambda x: F.array_join(F.slice("w", x["pos"] + 1, x["len"]), " ") == x["key"])
        hits = own.join(met, same).select(*row, F.explode(true).alias("x")).select(*row, "x.pos", "x.len", "x.items")
        every = split.select("id", "text_key", F.size("w").cast("long").alias("n_words"), F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("items"))
        found = hits.unionByName(every)
    grouped = found.groupBy(row).agg(
        F.sum((F.col("pos") < 0).cast("int")).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("pos") >= 0, F.struct("pos", "len")))).alias("at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )

    def union(spans: Column) -> Column:
        """Merged intervals of spans sorted by start: a span begins anew where no earlier one reaches it."""
        ends = F.transform(spans, lambda x: x["pos"] + x["len"])

        def merged(e: Column) -> Column:
            # Windows are short: of those before x, only the ones that start less than `window` words earlier can reach it.
            reach = lambda k: F.array_max(F.slice(e, F.greatest(k - window * len(lens), F.lit(0)) + 1, F.least(k, F.lit(window * max(1, len(lens))))))
            heads = F.filter(F.transform(spans, lambda x, k: F.struct(x["pos"].alias("pos"), k.alias("k"), F.when(k == 0, F.lit(-1)).otherwise(reach(k)).alias("before"))), lambda x: x["pos"] > x["before"])
            return let(heads, lambda h: F.transform(h, lambda x, j: F.struct(x["pos"].alias("start"), F.coalesce(F.get(h, j + 1)["before"], F.array_max(F.slice(e, x["k"] + 1, F.size(e)))).alias("end"))))

        return F.when(F.size(spans) > 0, let(ends, merged)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    spans = grouped.select("id", "n_words", "copies", "items", union(F.col("at")).alias("hits"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    judged = spans.select("id", "n_words", "hits", n_hit.alias("n_hit"), "items", "copies").withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")
