"""Exact cosine search of a batch of queries: products of blocks of queries and batches of vectors.

Each partition keeps its k best for each query, so what is shuffled is at most k rows a query and partition. A block
of queries holds up to BLOCK_BYTES of them, some ten thousand; more queries take more passes over the vectors.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import rows_of, unit_rows
from .bm25 import top_k

BLOCK_BYTES = 64 << 20
#: Of a batch, so many bytes of doubles meet so many queries at once.
SLICE_BYTES, QUERIES = 4 << 20, 256


def _merged(scores: np.ndarray, names: np.ndarray, more: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each query's held scores and names, and the scores of new names; ties by name."""
    scores = np.concatenate([scores, more], axis=1)
    names = np.concatenate([names, np.broadcast_to(new, more.shape)], axis=1)
    if scores.shape[1] <= k:
        return scores, names
    least = np.partition(scores, -k, axis=1)[:, -k]
    near = scores >= least[:, None]
    one = np.argsort(~near, axis=1, kind="stable")[:, :k]  # the first k that are near, all of them where there are no ties
    for q in np.flatnonzero(near.sum(axis=1) > k).tolist():
        own = np.flatnonzero(near[q])
        one[q] = own[sorted(range(len(own)), key=lambda x: (-scores[q, own[x]], names[q, own[x]]))[:k]]
    return np.take_along_axis(scores, one, axis=1), np.take_along_axis(names, one, axis=1)


def _best(batches: Iterable[pa.RecordBatch], queries: Broadcast, k: int, digits: int | None) -> Iterator[pa.RecordBatch]:
    wanted, dims = queries.value
    held = kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        step = max(1, min(4096, SLICE_BYTES // (8 * max(1, wanted.shape[1]))))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            rows, own = rows_of(part.column(1))
            rows = unit_rows(rows)
            width = min(wanted.shape[1], rows.shape[1])
            new = part.column(0).to_numpy(zero_copy_only=False)
            for q in range(0, len(wanted), QUERIES):
                scores = wanted[q : q + QUERIES, :width] @ rows[:, :width].T
                scores[dims[q : q + QUERIES, None] != own[None, :]] = 0.0
                if digits is not None:
                    scores = np.round(scores, digits) + 0.0
                if held is None:
                    held = {}
                before = held.get(q) or (np.zeros((len(scores), 0)), np.zeros((len(scores), 0), new.dtype))
                held[q] = _merged(*before, scores, new[None, :], k)
    for q, (scores, names) in (held or {}).items():
        if scores.shape[1]:
            numbers = np.repeat(np.arange(q, q + len(scores)), scores.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(names.ravel(), kind), pa.array(scores.ravel(), pa.float64())], names=["number", "chunk_id", "score"])


def _block(rest: Iterator, block: int | None) -> list:
    """The next queries: so many, or BLOCK_BYTES of doubles."""
    out, size = [], 0
    for row in rest:
        out.append(row)
        size += 8 * len(row["vector"] or ())
        if len(out) == block or (block is None and size >= BLOCK_BYTES):
            break
    return out


def cosine_search(vectors: DataFrame, queries: DataFrame, k: int, *, digits: int | None = None, block: int | None = None) -> DataFrame:
    """vectors (chunk_id, vector) and queries (query_id, vector) to (query_id, chunk_id, score, rank), the k nearest. All scores count, negative ones too."""
    spark, found = vectors.sparkSession, None
    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema, *queries.schema]}
    rest = queries.select("query_id", "vector").toLocalIterator() if k > 0 else iter(())
    while part := _block(rest, block):
        rows, dims = rows_of(pa.array([r["vector"] for r in part], pa.list_(pa.float64())))
        shared = spark.sparkContext.broadcast((unit_rows(rows), dims))
        one = vectors.select("chunk_id", "vector").mapInArrow(functools.partial(_best, queries=shared, k=k, digits=digits), f"number long, chunk_id {kinds['chunk_id']}, score double")
        names = spark.createDataFrame([(n, r["query_id"]) for n, r in enumerate(part)], f"number long, query_id {kinds['query_id']}")
        one = one.join(F.broadcast(names), "number").select("query_id", "chunk_id", "score")  # a block of names
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double, rank int")
    return top_k(found, k)
