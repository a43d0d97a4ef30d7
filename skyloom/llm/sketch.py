"""Counts by hash buckets, of fixed size whatever the input: each task packs its own, and blocks of them are summed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS, BLOCKS = 22, 64


def buckets(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def count(counts: np.ndarray, hashes: np.ndarray, bits: int = BITS) -> None:
    """Adds the hashes to counts, in place: no second array of that size for a slice."""
    np.add.at(counts, buckets(hashes, bits), 1)


def packed(counts: np.ndarray) -> list[bytes]:
    """One compressed blob for each block."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    return [squeeze.compress(x.astype("<u4").tobytes()) for x in np.split(counts, BLOCKS)]


def summed(blobs: DataFrame, small, bits: int = BITS) -> np.ndarray:
    """small (a function to bytes, one each) of the buckets' sums; blobs: block (int), counts (binary)."""

    def add(batches):
        import zstandard

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zstandard.decompress(blob), "<u4").astype(np.int64)
                total[block] = total[block] + part if block in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([small(x).astype(np.uint8).tobytes() for x in total.values()], pa.binary())], ["block", "small"])

    out = np.zeros((BLOCKS, (1 << bits) // BLOCKS), np.uint8)
    for r in blobs.select("block", "counts").repartition("block").mapInArrow(add, "block int, small binary").collect():  # BLOCKS rows
        out[r["block"]] = np.frombuffer(r["small"], np.uint8)
    return out.reshape(-1)
