"""Approximate cosine search: an inverted file of product-quantised codes, re-ranked by the vectors themselves.

Vectors of length 1 are filed under the nearest of a set of centres; what is left after subtracting the centre is cut in
sub-vectors, each replaced by the number of the nearest of 256 code words: a vector is a few bytes. A query looks into the
lists of its `probes` nearest centres, estimates each vector's product with it from tables of its products with all code
words, keeps the best `refine` times k, and computes their cosine exactly. Centres and code words are fitted to a
sample of at most SAMPLE vectors; every vector is filed.

With each code goes how far the vector is from what its code stands for; a product is off by no more than that. So
certain() is exact: it passes over a vector only if its code shows that it is not among the k best.

Only codes are read for all vectors of a list; whole vectors only for the candidates. Lists are dealt to blocks of about
BLOCK vectors, so that a list that holds a third of all vectors is many tasks' work.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import rows_of, unit_rows
from .bm25 import top_k

#: Vectors that centres and code words are fitted to, at most; 20,000 of 768 dimensions are 123 MB on the driver, once.
SAMPLE = 20_000
#: Centres at most, code words of a sub-vector, and a sub-vector's dimensions.
LISTS, WORDS, SUB = 256, 256, 4
#: About so many vectors of a list, and so many queries, meet in a task.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Where a search looks if it isn't told.
PROBES, REFINE = 16, 10


@dataclass(frozen=True)
class Codebook:
    """centres (lists, dim), words (sub-vectors, WORDS, SUB); dim counts the dimensions before they are filled up to whole sub-vectors."""

    centres: np.ndarray
    words: np.ndarray
    dim: int

    def padded(self, rows: np.ndarray) -> np.ndarray:
        return np.pad(rows, ((0, 0), (0, self.centres.shape[1] - rows.shape[1])))

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the code of each row of length 1."""
        rows = self.padded(rows)
        own = nearest(rows, self.centres)
        rest = (rows - self.centres[own]).reshape(len(rows), len(self.words), SUB)
        return own, np.stack([nearest(rest[:, m], self.words[m]) for m in range(len(self.words))], axis=1).astype(np.uint8)

    def distances(self, rows: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each row of length 1 is from what its list and code stand for."""
        held = np.stack([self.words[m][codes[:, m]] for m in range(len(self.words))], axis=1).reshape(len(rows), -1)
        return np.linalg.norm(self.padded(rows) - self.centres[own] - held, axis=1)

    def estimates(self, queries: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """About the products of queries and the vectors of a list with these codes."""
        queries = self.padded(queries)
        tables = np.einsum("qms,mws->qmw", queries.reshape(len(queries), len(self.words), SUB), self.words)
        out = np.repeat((queries @ self.centres[own])[:, None], len(codes), axis=1)
        for m in range(len(self.words)):
            out += tables[:, m, codes[:, m]]
        return out


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    length = (centres**2).sum(axis=1)
    parts = [(length - 2 * rows[at : at + 4096] @ centres.T).argmin(axis=1) for at in range(0, len(rows), 4096)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _means(rows: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """n centres of rows, by rounds of assigning and averaging; a centre that loses all its rows stays where it is."""
    centres = rows[rng.choice(len(rows), n, replace=len(rows) < n)].copy()
    for _ in range(rounds):
        own = nearest(rows, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, rows)
        size = np.bincount(own, minlength=n)[:, None]
        centres = np.where(size > 0, total / np.maximum(size, 1), centres)
    return centres


def fit(rows: np.ndarray, seed: int = 7) -> Codebook:
    """Rows of length 1 to a codebook."""
    rng, dim = np.random.default_rng(seed), rows.shape[1]
    rows = np.pad(rows, ((0, 0), (0, -dim % SUB)))
    centres = _means(rows, max(1, min(LISTS, int(np.sqrt(len(rows))))), rng)
    rest = (rows - centres[nearest(rows, centres)]).reshape(len(rows), -1, SUB)
    return Codebook(centres, np.stack([_means(rest[:, m], WORDS, rng) for m in range(rest.shape[1])]), dim)


def fit_sample(vectors: DataFrame, sample: int = SAMPLE) -> Codebook | None:
    """From the vectors (chunk_id, vector) with the smallest hashes of their ids, those of the most frequent dimension; None without usable ones."""
    usable = vectors.filter("size(vector) > 0 and exists(vector, x -> x <> 0) and forall(vector, x -> x is not null and not isnan(x))")
    rows = usable.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").collect()
    if not rows:
        return None
    dims = np.array([len(r["vector"]) for r in rows])
    dim = int(np.bincount(dims).argmax())
    return fit(unit_rows(np.array([r["vector"] for r, n in zip(rows, dims, strict=True) if n == dim], np.float64)))


def save(spark: SparkSession, book: Codebook, path: str) -> None:
    row = (book.dim, *book.words.shape[:2], len(book.centres), book.centres.tobytes(), book.words.tobytes())
    spark.createDataFrame([row], "dim int, subs int, words int, lists int, centres binary, code_words binary").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> Codebook:
    r = spark.read.parquet(path).first()
    return Codebook(np.frombuffer(r["centres"]).reshape(r["lists"], -1), np.frombuffer(r["code_words"]).reshape(r["subs"], r["words"], SUB), r["dim"])


def _coded(batches: Iterable[pa.RecordBatch], book: Broadcast) -> Iterator[pa.RecordBatch]:
    b = book.value
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            rows, dims = rows_of(part.column(1))
            good = (dims == b.dim) & np.isfinite(rows).all(axis=1) & (np.linalg.norm(rows, axis=1) > 0)
            own, codes = np.full(len(rows), -1), np.zeros((len(rows), len(b.words)), np.uint8)
            off = np.zeros(len(rows))
            if good.any():
                unit = unit_rows(rows[good, : b.dim])
                own[good], codes[good] = b.encode(unit)
                off[good] = b.distances(unit, own[good], codes[good])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)], names=[*part.schema.names, "list", "code", "off"])


def coded(vectors: DataFrame, book: Broadcast) -> DataFrame:
    """Rows (chunk_id, vector, ...) with list, code, the code's distance and the list's block; vectors that have no cosine, or another dimension, are in list -1."""
    extra = [c for c in vectors.columns if c not in ("chunk_id", "vector")]
    rows = vectors.select("chunk_id", "vector", *extra)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(functools.partial(_coded, book=book), f"{schema}, list int, code binary, off double").withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)).cast("int"))


def _probed(batches: Iterable[pa.RecordBatch], book: Broadcast, probes: int) -> Iterator[pa.RecordBatch]:
    b = book.value
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            rows, dims = rows_of(part.column(1))
            use = np.flatnonzero((dims == b.dim) & (np.linalg.norm(rows, axis=1) > 0))
            near = np.argsort(-(b.padded(unit_rows(rows[use, : b.dim])) @ b.centres.T), axis=1, kind="stable")[:, :probes] if len(use) else np.zeros((0, 0), int)
            q = np.repeat(use, near.shape[1])
            yield pa.RecordBatch.from_arrays([c.take(pa.array(q)) for c in part.columns] + [pa.array(near.ravel().astype(np.int32))], names=["query_id", "vector", "list"])


def _estimated(key: tuple, queries: pa.Table, vectors: pa.Table, book: Broadcast, most: int) -> pa.Table:
    kinds = pa.schema([queries.schema.field("query_id"), vectors.schema.field("chunk_id"), pa.field("score", pa.float64())])
    if not len(queries) or not len(vectors):
        return pa.table([pa.array([], f.type) for f in kinds], schema=kinds)
    b, vectors = book.value, vectors.sort_by("chunk_id")
    codes = np.frombuffer(b"".join(vectors["code"].to_pylist()), np.uint8).reshape(len(vectors), -1)
    scores = b.estimates(unit_rows(rows_of(queries["vector"])[0]), key[0].as_py(), codes)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :most]
    q = np.repeat(np.arange(len(scores)), best.shape[1])
    return pa.table([queries["query_id"].take(pa.array(q)), vectors["chunk_id"].take(pa.array(best.ravel())), pa.array(scores[q, best.ravel()])], schema=kinds)


def candidates(rows: DataFrame, queries: DataFrame, book: Broadcast, most: int, probes: int) -> DataFrame:
    """coded() rows and queries (query_id, vector) to the `most` best of each query by their codes: (query_id, chunk_id)."""
    kinds = queries.schema["query_id"].dataType.simpleString(), rows.schema["chunk_id"].dataType.simpleString()
    asked = queries.select("query_id", "vector")
    asked = asked.mapInArrow(functools.partial(_probed, book=book, probes=probes), f"query_id {kinds[0]}, vector {asked.schema['vector'].dataType.simpleString()}, list int")
    codes = rows.filter("list >= 0").select("list", "block", "chunk_id", "code")
    parts = codes.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    wanted = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("turns")).join(parts, "list")
    # each block of a list meets each block of its queries once
    left = asked.join(wanted, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int").alias("turn"), "query_id", "vector")
    right = codes.join(wanted, "list").select("list", F.pmod("block", "blocks").alias("own"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "chunk_id", "code")
    met = left.groupBy("list", "own", "turn").cogroup(right.groupBy("list", "own", "turn")).applyInArrow(functools.partial(_estimated, book=book, most=most), f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
    return top_k(met, most).select("query_id", "chunk_id")


def _certain(key: tuple, queries: pa.Table, vectors: pa.Table, book: Broadcast, k: int, digits: int | None) -> pa.Table:
    kinds = pa.schema([queries.schema.field("query_id"), vectors.schema.field("chunk_id"), pa.field("score", pa.float64())])
    b, vectors, out = book.value, vectors.sort_by("chunk_id"), []
    slack = 1e-9 if digits is None else 10.0**-digits
    for at in range(0, len(queries) if len(vectors) else 0, 256):
        part = queries.slice(at, 256)
        asked, least = unit_rows(rows_of(part["vector"])[0]), part["least"].fill_null(-np.inf).to_numpy()
        for begin in range(0, len(vectors), 2048):
            own = vectors.slice(begin, 2048)
            codes = np.frombuffer(b"".join(own["code"].to_pylist()), np.uint8).reshape(len(own), -1)
            may = b.estimates(asked, key[0].as_py(), codes) + own["off"].to_numpy() >= least[:, None] - slack
            use = np.flatnonzero(may.any(axis=0))
            scores = asked @ unit_rows(rows_of(own["vector"].take(pa.array(use)))[0]).T if len(use) else np.zeros((len(part), 0))
            scores = np.where(may[:, use], scores if digits is None else np.round(scores, digits) + 0.0, -np.inf)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # in order of ids where scores are equal
            score, q = np.take_along_axis(scores, best, axis=1).ravel(), np.repeat(np.arange(len(part)), best.shape[1])
            found = np.flatnonzero(score > -np.inf)
            out.append(pa.table([part["query_id"].take(pa.array(q[found])), own["chunk_id"].take(pa.array(use[best.ravel()[found]])), pa.array(score[found])], schema=kinds))
    return pa.concat_tables(out) if out else kinds.empty_table()


def certain(rows: DataFrame, queries: DataFrame, book: Broadcast, k: int, digits: int | None = None) -> DataFrame:
    """coded() rows and queries (query_id, vector, least) to each query's k best of the vectors in lists: (query_id, chunk_id, score, rank).

    least: a score that the k-th best reaches, null if there is none. All lists are visited; a vector is compared if its code allows that its score reaches `least`.
    """
    kinds = queries.schema["query_id"].dataType.simpleString(), rows.schema["chunk_id"].dataType.simpleString()
    held = rows.filter("list >= 0").select("list", "block", "chunk_id", "code", "off", "vector")
    parts = held.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    turns = queries.agg(F.greatest(F.ceil(F.count("*") / QUERY_BLOCK), F.lit(1)).cast("int").alias("turns"))  # one row
    wanted = parts.crossJoin(F.broadcast(turns))
    usable = queries.filter((F.size("vector") == book.value.dim) & F.exists("vector", lambda x: x != 0))
    left = usable.crossJoin(F.broadcast(wanted)).select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int").alias("turn"), "query_id", "vector", "least")
    right = held.join(F.broadcast(wanted), "list").select("list", F.pmod("block", "blocks").alias("own"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "chunk_id", "code", "off", "vector")
    met = left.groupBy("list", "own", "turn").cogroup(right.groupBy("list", "own", "turn")).applyInArrow(functools.partial(_certain, book=book, k=k, digits=digits), f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
    return top_k(met, k)
