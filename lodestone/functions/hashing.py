"""FNV-1a and MinHash in unsigned 64-bit arithmetic, which numpy has and ANSI SQL has not."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import slices

# FNV-1a's offset and prime; the golden-ratio constant; the seed and multipliers of SplitMix64.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
GOLDEN = 0x9E3779B97F4A7C15
SALT_SEED = 0x243F6A8885A308D3
SPLITMIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
HASHES, SHINGLE = 64, 3


def fnv1a_all(items: list[bytes]) -> np.ndarray:
    """FNV-1a of each item, all items a byte at a time."""
    out = np.full(len(items), FNV_OFFSET, np.uint64)
    size = np.fromiter(map(len, items), np.int64, len(items))
    order = np.argsort(-size, kind="stable")
    flat, begin = np.frombuffer(b"".join(items), np.uint8), np.cumsum(size) - size
    live = -size[order]
    for k in range(int(size.max()) if len(items) else 0):
        own = order[: np.searchsorted(live, -k, "left")]  # those longer than k
        out[own] = (out[own] ^ flat[begin[own] + k]) * np.uint64(FNV_PRIME)
    return out


def salts(n: int = HASHES) -> np.ndarray:
    """The first n numbers of SplitMix64."""
    state = np.uint64(SALT_SEED) + np.uint64(GOLDEN) * np.arange(1, n + 1, dtype=np.uint64)
    z = (state ^ (state >> np.uint64(30))) * np.uint64(SPLITMIX[0])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SPLITMIX[1])
    return z ^ (z >> np.uint64(31))


def _fnv1a(column: pa.Array) -> pa.Array:
    known = column.cast(pa.binary())
    return pa.array(np.ma.MaskedArray(fnv1a_all([x or b"" for x in known.to_pylist()]).view(np.int64), mask=np.asarray(known.is_null())), from_pandas=True)


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, its bits as a bigint. Apply it to distinct values."""
    return F.arrow_udf(_fnv1a, "bigint")(text)


def _bucket_counts(column: pa.Array, dim: int) -> pa.Array:
    parts = []
    for begin, end in slices(column):
        own = column.slice(begin, end - begin)
        items = own.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(own)), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        bucket = (fnv1a_all(items.dictionary.cast(pa.binary()).to_pylist()) % np.uint64(dim)).astype(np.int64)
        place, n = np.unique(row * dim + bucket[items.indices.to_numpy(zero_copy_only=False)], return_counts=True)
        ends = np.searchsorted(place, np.arange(len(own) + 1) * dim)
        counts = pa.StructArray.from_arrays([pa.array(place % dim, pa.int32()), pa.array(n, pa.int64())], ["bucket", "n"])
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), counts))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int64())])))


def bucket_counts(words: Column, dim: int) -> Column:
    """How many of an array's words fall in each bucket by FNV-1a modulo dim, as an array of (bucket, n) without empty ones."""
    return F.arrow_udf(lambda column: _bucket_counts(column, dim), "array<struct<bucket:int,n:bigint>>")(words)


def unsigned(value: Column) -> Column:
    """A bigint's bits as an unsigned decimal(20,0)."""
    wide = value.cast("decimal(20,0)")
    return F.when(value < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def shingles(tokens: Column) -> Column:
    """The runs of SHINGLE tokens of an array, joined by spaces; the single tokens where there are fewer. Repeated ones stay.

    tokens should be a column that is there: an expression would be computed again for each run.
    """
    several = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - SHINGLE + 1, F.lit(1))), lambda k: F.array_join(F.slice(tokens, k, SHINGLE), " "))
    return F.when(F.size(tokens) >= SHINGLE, several).otherwise(tokens)


def signatures(texts: list[list[str]]) -> np.ndarray:
    """For each list of tokens the smallest salted hash for each slot over its shingles, single tokens where there are fewer than SHINGLE.

    Each distinct shingle is hashed once. A list without tokens has the largest number in all slots.
    """
    number: dict[str, int] = {}
    rows = []
    for tokens in texts:
        parts = map(" ".join, zip(*(tokens[k:] for k in range(SHINGLE)), strict=False)) if len(tokens) >= SHINGLE else tokens
        rows.append(np.fromiter({number.setdefault(p, len(number)) for p in parts}, np.int64))
    base, salt = fnv1a_all([p.encode() for p in number]), salts()
    out = np.full((len(texts), HASHES), 2**64 - 1, np.uint64)
    for k, own in enumerate(rows):
        for at in range(0, len(own), 4096):
            np.minimum(out[k], ((base[own[at : at + 4096], None] ^ salt) * np.uint64(GOLDEN)).min(axis=0), out=out[k])
    return out


def _signatures(column: pa.Array) -> pa.Array:
    out = np.empty((len(column), HASHES), np.int64)
    for begin, end in slices(column, rows=256):
        out[begin:end] = signatures([t or [] for t in column.slice(begin, end - begin).to_pylist()]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * HASHES, pa.int32()), pa.array(out.ravel()), mask=column.is_null())


def minhash(tokens: Column) -> Column:
    """MinHash signature of an array of tokens: HASHES slots, unsigned numbers as bigints."""
    return F.arrow_udf(_signatures, "array<bigint>")(tokens)


def estimated_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(HASHES))
