"""Slices of Arrow columns by bytes: what Python makes of a batch is many times its size, and a batch is as large as Spark and the texts make it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text of a slice; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def _ends(column: pa.Array) -> np.ndarray:
    """Where each text begins, and the last ends, in the column's bytes: as they lie in memory, no copy."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = column.buffers()[1]
    if not offsets:
        return np.zeros(1, np.int64)
    return np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]


def text_bytes(column: pa.Array) -> np.ndarray:
    """The bytes of each row of a column of texts, or of lists of texts."""
    if pa.types.is_list(column.type):
        return np.diff(_ends(column.values)[column.offsets.to_numpy()].astype(np.int64))
    return np.diff(_ends(column).astype(np.int64))


def slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = 512) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of rows of at most so many bytes and rows, one row at least."""
    before, at = np.concatenate([[0], np.cumsum(text_bytes(column))]), 0
    while at < len(column):
        end = int(np.searchsorted(before, before[at] + most, "right")) - 1
        end = min(max(end, at + 1), at + rows, len(column))
        yield at, end
        at = end
