"""Texts of Arrow batches as arrays of bytes, in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
#: Slices of operators whose arrays take tens of bytes for one of text, in workers that stand beside others.
SMALL_BYTES = 1 << 20


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of row ranges of about `most` bytes of text, a single longer text alone; null is empty.  bytes are UTF-8; offsets has one entry more than rows."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        end = min(end, n)
        yield first, end, whole[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def releasing(run, tokens: bool = False):
    """run, a function over Arrow batches, which at a task's end gives memory that Arrow's pool and the C library have kept back to the system: a worker lives on, beside those of later stages.  Transducers that earlier tasks have compiled go first, unless run works on tokens."""

    def released(batches):
        from .bpe import forget

        if not tokens:
            forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone
                trim(0)

    return released
