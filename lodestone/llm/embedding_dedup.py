"""Embedding near-dedup by spherical-cap filters.

Filter directions are a structured random product code: a vector is rotated and cut in four blocks, each with a random
codebook, and every choice of one codeword a block is a direction, millions of them without storing one. A vector
is list-decoded to all directions whose product with it reaches its threshold, that of its CAP_DIRECTIONS-th best: one threshold for
all vectors leaves some without any direction, and takes a thousand directions for the others to find as much (64 dimensions: at
4 standard deviations 10 % of vectors have none). Vectors that share a direction meet in a join on the filter and are verified by cosine in
double precision. Equal vectors are one class from the start, and a pair is verified and counted only at its smallest common
direction. No pairs leave a task: each vector's number of links and one link towards the block's root do.

A pair at cosine exactly 0.95 shares no direction of one code with a chance of 0.1 or less from 64 dimensions on (0.2 at 8), and none
of TABLES independent codes with one of 1e-4 (2e-3); closer pairs much more rarely. exact=True compares all vectors, in blocks, for those who must not
miss one and have few enough.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with nothing, as do
rows with a null id and vectors of another length than their partner's; rows that repeat an id and vector count as one vector;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read_table, stored
from .graphs import components, group_starts, in_blocks, roots, whole_groups

THRESHOLD = 0.95
#: Independent product codes, and the directions in which a vector is a filter's in each.
TABLES, CAP_DIRECTIONS = 4, 24
#: Blocks of a code.
PARTS = 4
#: Directions of a code for each vector: how rarely unrelated vectors meet.
ROOM = 1600
BLOCK = 256
SEED = 20240


def codewords(n_vectors: int) -> int:
    """Codewords a block, for directions in proportion to the vectors."""
    return int(min(256, max(16, np.ceil((max(1, n_vectors) * ROOM) ** (1 / PARTS)))))


@functools.lru_cache(8)
def product_code(dim: int, words: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    """A rotation (of dim filled up to a multiple of PARTS) and the codebooks."""
    rng, wide = np.random.default_rng([SEED, dim, table]), -(-dim // PARTS) * PARTS
    rotation = np.linalg.qr(rng.standard_normal((wide, wide)))[0]
    part = wide // PARTS
    books = rng.standard_normal((PARTS, min(words, 2 if part == 1 else 4**part), part))
    if part == 1:  # there are two directions
        books[:, :, 0] = (1, -1)
    return rotation[:dim], books / (np.linalg.norm(books, axis=2, keepdims=True) * np.sqrt(PARTS))


def list_decode(scores: np.ndarray, most: int) -> np.ndarray:
    """scores (PARTS x words): the directions, as numbers, whose score reaches that of the `most`-th best. They lie in the best of either half."""
    words = scores.shape[1]
    left = (scores[0][:, None] + scores[1][None, :]).ravel()
    right = (scores[2][:, None] + scores[3][None, :]).ravel()
    a, b = (np.argpartition(-half, most - 1)[:most] if len(half) > most else np.arange(len(half)) for half in (left, right))
    both = (left[a][:, None] + right[b][None, :]).ravel()
    x = np.flatnonzero(both >= np.partition(both, -most)[-most]) if len(both) > most else np.arange(len(both))
    return a[x // len(b)].astype(np.int64) * words * words + b[x % len(b)]


def directions(vectors: np.ndarray, words: int) -> list[np.ndarray]:
    """For each unit vector its sorted filters in all tables."""
    out: list[list[np.ndarray]] = [[] for _ in vectors]
    for table in range(TABLES):
        rotation, books = product_code(vectors.shape[1], words, table)
        turned = (vectors @ rotation).reshape(len(vectors), PARTS, -1)
        scores = np.einsum("npd,pwd->npw", turned, books, optimize=True)
        for found, s in zip(out, scores, strict=True):
            found.append(list_decode(s, CAP_DIRECTIONS) * TABLES + table)
    return [np.sort(np.concatenate(x)) for x in out]


def unit_rows(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as unit rows of a matrix, filled with zeros to the widest, and their dimensions."""
    rows, dims = rows_of(column)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True), dims


def rows_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    dims, values = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(dims), int(dims.max()) if len(dims) else 0), values.dtype if values.dtype.kind == "i" else np.float64)
    out[np.repeat(np.arange(len(dims)), dims), np.arange(len(values)) - np.repeat(np.cumsum(dims) - dims, dims)] = values
    return out, dims


def _decode(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            units, dims = unit_rows(part.column("embedding"))
            found: list = [None] * len(units)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                for k, f in zip(own.tolist(), directions(units[own, :dim], words), strict=True):
                    found[k] = f
            if found:
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("copies"), part.column("embedding"), pa.array(found, pa.list_(pa.int64()))], names=["rep", "copies", "embedding", "filters"])


def _smaller_common(filters: np.ndarray, here: int) -> np.ndarray:
    """filters (rows x longest list, -1 where shorter) of one group's rows: which pairs of rows share a filter below `here`."""
    row, col = np.nonzero((filters >= 0) & (filters < here))
    code, count = np.unique(filters[row, col], return_inverse=True, return_counts=True)[1:]
    shared = count[code] > 1
    code, row = np.unique(code[shared], return_inverse=True)[1], row[shared]
    common, width = np.zeros((len(filters), len(filters)), np.float32), 4096
    for at in range(0, int(code.max()) + 1 if len(code) else 0, width):
        has = np.zeros((len(filters), width), np.float32)
        mine = (code >= at) & (code < at + width)
        has[row[mine], code[mine] - at] = 1
        common += has @ has.T
    return common > 0


class Links:
    """A task's links: of each vector how many, and the smallest that it is linked to so far. Only that leaves the task."""

    def __init__(self) -> None:
        self.rep, self.count, self.root = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, p: np.ndarray, q: np.ndarray, of_p: np.ndarray, of_q: np.ndarray) -> None:
        """Links p-q; of_p and of_q say for how many copies each end counts."""
        rep, place = np.unique(np.concatenate([self.rep, self.root, p, q]), return_inverse=True)
        was, root, p, q = np.split(place, np.cumsum([len(self.rep), len(self.root), len(p)]))
        count = np.bincount(was, self.count, len(rep)) + np.bincount(p, of_q, len(rep)) + np.bincount(q, of_p, len(rep))
        low = roots(len(rep), np.concatenate([was, p]), np.concatenate([root, q]))
        self.rep, self.count, self.root = rep, count.astype(np.int64), rep[low]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.rep), pa.array(self.count), pa.array(self.root)], names=["rep", "links", "root"])


#: Vectors with links that a task holds before it writes them.
HELD = 200_000


def _verify(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Compares the rows of each filter's blocks. A pair is a link at its smallest common filter alone."""
    links = Links()
    for table in whole_groups(batches, ["filter", "i", "j"], 4000):
        n = table.num_rows
        matrix, dims = unit_rows(table["embedding"])
        lists, sizes = rows_of(table["filters"])
        filters = np.where(np.arange(lists.shape[1]) < sizes[:, None], lists, -1)
        here, rep, copies, i, j, own = (table[c].to_numpy() for c in ("filter", "rep", "copies", "i", "j", "own"))
        starts = group_starts(table, ["filter", "i", "j"])
        found: list[list[np.ndarray]] = [[], []]
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
            if end - begin < 2:
                continue
            at = slice(begin, end)
            close = np.triu(matrix[at] @ matrix[at].T >= threshold, 1) & (dims[at][:, None] == dims[at][None, :])
            if i[begin] != j[begin]:
                close &= own[at][:, None] != own[at][None, :]
            if close.any():
                p, q = np.nonzero(close & ~_smaller_common(filters[at], int(here[begin])))
                found[0].append(p + begin)
                found[1].append(q + begin)
        if found[0]:
            p, q = map(np.concatenate, found)
            links.add(rep[p], rep[q], copies[p], copies[q])
        if len(links.rep) > HELD:
            yield links.batch()
            links = Links()
    if len(links.rep):
        yield links.batch()


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, *, exact: bool = False) -> DataFrame:
    """Rows (vec_id, embedding) to (vec_id, n_links, component_id, kept), one for each row. exact: without filters, all against all."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    usable = rows.filter(sound)
    classes = stored(usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies")), "vectors")
    plain = classes.select("rep", "copies", "embedding")
    decode = functools.partial(_decode, words=codewords(classes.count()))
    filtered = plain.withColumn("filters", F.array(F.lit(0).cast("long"))) if exact else plain.mapInArrow(decode, "rep long, copies long, embedding array<double>, filters array<bigint>")
    decoded = stored(filtered, "filters")
    met = in_blocks(decoded.select("rep", F.explode("filters").alias("filter")), "filter", "rep", BLOCK)
    dealt = met.join(decoded, "rep").select("filter", "i", "j", "own", "rep", "copies", "embedding", "filters").repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j")
    found = stored(dealt.mapInArrow(functools.partial(_verify, threshold=threshold), "rep long, links long, root long"), "near")
    discard(decoded)
    labels = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(counts, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left")
    known = known.select("embedding", "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = usable.join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: All pairs, and what each vector reaches.
OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
sound AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, vec_id = low AS kept FROM v JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
