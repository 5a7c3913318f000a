"""Vector expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms up to the smallest single-precision step count as zero.
TINY = 1.1920929e-07


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Length 1; vectors of no length stay as they are."""
    n = norm(v)
    return F.when(n > TINY, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v.cast("array<float>"))


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths or vectors of no length."""
    both = norm(a) * norm(b)
    good = (F.size(a) == F.size(b)) & (norm(a) > TINY) & (norm(b) > TINY)
    return F.when(good, dot(a, b) / both).otherwise(0.0)


def rows_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of vectors as the rows of a matrix, filled with zeros to the widest, and their dimensions (null: 0)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    dims = pc.list_value_length(column).fill_null(0).to_numpy().astype(np.int64)
    values, n = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), len(dims)
    width = int(dims.max()) if n else 0
    if n and (dims == width).all():
        return values.reshape(n, width), dims
    out = np.zeros((n, width))
    out[np.repeat(np.arange(n), dims), np.arange(len(values)) - np.repeat(np.cumsum(dims) - dims, dims)] = values
    return out, dims


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of no length become zeros."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.where(length > TINY, rows / np.maximum(length, TINY), 0.0)


def as_lists(matrix: np.ndarray) -> pa.Array:
    """A matrix's rows as a column of single-precision vectors."""
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.astype(np.float32, copy=False).ravel(), pa.float32()))


def _encode(column: pa.Array) -> pa.Array:
    return pa.array([None if v is None else np.array(v, "<f4").tobytes() for v in column.to_pylist()], pa.binary())


def _decode(column: pa.Array) -> pa.Array:
    return pa.array([None if b is None else np.frombuffer(b, "<f4") if len(b) % 4 == 0 else np.zeros(0, "<f4") for b in column.to_pylist()], pa.list_(pa.float32()))


def encode_vector(v: Column) -> Column:
    """Little-endian single-precision bytes."""
    return F.arrow_udf(_encode, "binary")(v)


def decode_vector(data: Column) -> Column:
    """The reverse; bytes of a length that is no multiple of four give an empty vector."""
    return F.arrow_udf(_decode, "array<float>")(data)
