"""Embedders: anything with a model_id, a dim and a column of vectors for a column of texts."""

from __future__ import annotations

import itertools
from typing import Protocol

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..functions.hashing import fnv1a_all
from ..functions.vectors import TINY, as_lists


class Embedder(Protocol):
    model_id: str
    dim: int

    def vectors(self, text: Column) -> Column: ...


def words(text: str) -> list[str]:
    """What stands between spaces, as regex has them: to split() 0x1C to 0x1F are spaces too."""
    return [w for w in regex.split(r"\s+", text) if w] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


def bucket_counts(texts: list[str | None], dim: int) -> np.ndarray:
    """How often words, lower-cased, fall in each bucket by FNV-1a; each distinct word is hashed once."""
    rows = [words((t or "").lower()) for t in texts]
    flat = list(itertools.chain.from_iterable(rows))
    distinct = dict.fromkeys(flat)
    bucket = dict(zip(distinct, (fnv1a_all([w.encode() for w in distinct]) % np.uint64(dim)).tolist(), strict=True))
    place = np.repeat(np.arange(len(rows)) * dim, list(map(len, rows))) + np.fromiter(map(bucket.__getitem__, flat), np.int64, len(flat))
    return np.bincount(place, minlength=len(rows) * dim).astype(np.float64).reshape(len(rows), dim)


class HashEmbedder:
    """Bag of hashed words, of length 1. Needs no model: for tests and offline use."""

    def __init__(self, dim: int = 768, model_id: str = "hash-words") -> None:
        self.dim, self.model_id = dim, model_id

    def embed(self, texts: list[str | None]) -> np.ndarray:
        counts = bucket_counts(texts, self.dim)
        length = np.linalg.norm(counts, axis=1, keepdims=True)
        return np.where(length > TINY, counts / np.maximum(length, TINY), counts).astype(np.float32)

    def vectors(self, text: Column) -> Column:
        embed, dim = self.embed, self.dim

        def run(texts: pa.Array) -> pa.Array:
            out = np.empty((len(texts), dim), np.float32)
            for begin, end in slices(texts):
                out[begin:end] = embed(texts.slice(begin, end - begin).to_pylist())
            return as_lists(out)

        return F.arrow_udf(run, "array<float>")(text)
