"""Packing of tokenized documents into sequences: shortest-pack-first over the histogram of lengths.

Documents are cut at every full sequence; the rest of each is one piece.  The histogram has at most as many entries as a sequence has
tokens, so the packing is planned on the driver in time that doesn't grow with the corpus, as patterns of lengths
with counts.  Pieces get a rank among those of their length, and patterns own ranges of ranks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import releasing
from .common import ship, written

SEQUENCE = 1024
END_ID = 0


def pieces_of(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece."""
    ship(docs.sparkSession)

    def run(batches):
        from .arrow import SMALL_BYTES, slices
        from .bpe import transducer

        machine = transducer(path)
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1), SMALL_BYTES):
                ids, at = machine.ids(data, offsets)
                rows, starts, lengths, crcs, totals = [], [], [], [], []
                last = np.array([END_ID], "<u4")
                for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    own = np.concatenate([ids[a:b], last]).astype("<u4")
                    for s in range(0, len(own), size):
                        piece = own[s : s + size]
                        rows.append(first + row)
                        starts.append(s)
                        lengths.append(len(piece))
                        crcs.append(zlib.crc32(piece.data))
                        totals.append(len(own))
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.make_valid_utf8(F.col(text_col)).cast("binary").alias("text"))
    schema = T.StructType([source.schema["doc_id"], *[T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens")]])
    return source.mapInArrow(releasing(run, tokens=True), schema)


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, number of such packs): each length goes, longest first, to the shortest pack; where none has room, as few new ones are opened as hold all that is left of it."""
    room: dict[int, list[list]] = defaultdict(list)  # by free tokens: [pattern, count]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = max((r for r in room if r >= length), default=0)
            if free:
                pattern, count = room[free].pop()
                if not room[free]:
                    del room[free]
                used = min(count, left)
                if count > used:
                    room[free].append([pattern, count - used])
            else:
                free, pattern, used = size, (), -(-left // (size // length))
            room[free - length].append([(*pattern, length), used])
            left -= used
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for packs in room.values():
        for pattern, count in packs:
            merged[pattern] += count
    return sorted(merged.items(), reverse=True)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): which ranks of a length go where."""
    ranks: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            out.append((length, ranks[length], ranks[length] + count, sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE) -> DataFrame:
    """The pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end token alone.  Each row of docs is a document, also where ids repeat or are
    null; other columns are not read.  An empty table has no pieces.
    """
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, path, id_col, text_col, size), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = max(64, sum(counts.values()) // (4 * parts))  # pieces ranked together: a common length is split
    salts = spark.createDataFrame([(n, max(1, -(-c // group))) for n, c in counts.items()], "length long, salts long")
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts"))
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", key)  # at most `size` rows
    sizes = salted.groupBy("length", "salt").count()  # at most 4 rows a partition, and one a length
    before = sizes.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    row = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = salted.withColumn("row", row).join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("row") - 1)
    places = spark.createDataFrame(slots(plan(counts, size)), "of long, lo long, hi long, base long, offset long")
    found = ranked.join(F.broadcast(places), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
