"""Exact cosine search of any number of queries, without comparing all pairs: balls around pivots, skipped by the triangle inequality.

Vectors of length 1 lie at chord distance sqrt(2 - 2 cos). Each is filed with the pivot nearest to it; within a ball, by its distance
from the pivot, in blocks of BLOCK vectors, so that a block is a ring [lo, hi] around its pivot. A query at distance d from the
pivot is at least max(d - hi, lo - d) away from everything in the ring.

A search is one plan. Each query first visits the rings nearest to it, in its nearest balls; the distance of its k-th best
there bounds how far a better one can be. It then visits the rings that are not farther. Queries meet vectors in blocks on both sides, one
product of matrices each: a ring that many queries visit is copied for every QUERY_BLOCK of them, so no task holds more
than a block of either. Nothing passes through the driver but the pivots, whose number is a parameter.

Defined results, as cosine_search() has them: vectors of no length, or of another dimension than the index has, score 0 for
every query, and a query of no length scores 0 everywhere; ties go by chunk id; a query of another dimension is an error.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import TINY, rows_of, unit_rows
from .bm25 import top_k

#: Pivots at most: 4,096 vectors of 768 dimensions are 12 MB that every task gets.
PIVOTS = 1024
#: A ring's vectors, as a power of two, and how many queries meet it at once.
BLOCK_BITS, QUERY_BLOCK = 11, 1024
#: Rings that a query visits first, in so many balls.
FIRST_BALLS, FIRST_RINGS = 2, 2


@dataclass(frozen=True)
class MetricIndex:
    """Tables under path: vectors (ball, ring, distance, chunk_id, vector), rings (ball, ring, lo, hi, n), odd (chunk_id), pivots (ball, vector)."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def pivots(self) -> np.ndarray:
        rows = self.table("pivots").orderBy("ball").collect()  # PIVOTS at most
        return np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1)


def _units(column: pa.Array, dim: int) -> np.ndarray:
    rows, dims = rows_of(column)
    if (dims != dim).any():
        raise ValueError(f"a query has {dims[dims != dim][0]} dimensions, the index has {dim}")
    return unit_rows(rows)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Between rows of length 1 and pivots of length 1."""
    return np.sqrt(np.maximum(2 - 2 * (rows @ pivots.T), 0))


def _filed(batches: Iterable[pa.RecordBatch], pivots: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            rows, dims = rows_of(part.column(1))
            away = _distances(unit_rows(rows), pivots.value)
            ball = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ball, pa.int32()), pa.array(away[np.arange(len(ball)), ball]), *part.columns], names=["ball", "distance", "chunk_id", "vector"])


def build_metric_index(vectors: DataFrame, path: str, *, pivots: int = PIVOTS, block_bits: int = BLOCK_BITS) -> MetricIndex:
    """An index of vectors (chunk_id, vector). Pivots are those with the smallest hashes of their ids, so that a rerun over the same ids finds the same."""
    spark = vectors.sparkSession
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    own = vectors.select("chunk_id", "vector")
    good = F.coalesce(F.size("vector") > 0, F.lit(False)) & (F.coalesce(length, F.lit(0.0)) > TINY) & ~F.isnan(length) & (length < float("inf"))
    common = own.filter(good).groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = common["dim"] if common else 0
    usable = own.filter(good & (F.size("vector") == dim))
    chosen = usable.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(pivots).select("vector").collect()  # a bounded sample; all vectors are filed
    matrix = unit_rows(np.array([r["vector"] for r in chosen], np.float64).reshape(len(chosen), dim))
    matrix = np.unique(matrix, axis=0)
    spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(matrix)], "ball int, vector array<double>").coalesce(1).write.parquet(f"{path}/pivots")
    own.filter(~(good & (F.size("vector") == dim)) | F.col("vector").isNull()).select("chunk_id").write.parquet(f"{path}/odd")
    kind = own.schema["chunk_id"].dataType.simpleString(), own.schema["vector"].dataType.simpleString()
    if common:
        filed = usable.mapInArrow(functools.partial(_filed, pivots=spark.sparkContext.broadcast(matrix)), f"ball int, distance double, chunk_id {kind[0]}, vector {kind[1]}")
    else:
        filed = spark.createDataFrame([], f"ball int, distance double, chunk_id {kind[0]}, vector {kind[1]}")
    placed = filed.repartitionByRange("ball", "distance").sortWithinPartitions("ball", "distance")
    placed.withColumn("ring", F.shiftright(F.monotonically_increasing_id(), block_bits)).write.parquet(f"{path}/vectors")
    index = MetricIndex(spark, path)
    index.table("vectors").groupBy("ball", "ring").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count("*").alias("n")).write.parquet(f"{path}/rings")
    return index


def _near_balls(batches: Iterable[pa.RecordBatch], pivots: Broadcast, reach: Broadcast, first: int | None) -> Iterator[pa.RecordBatch]:
    """Queries (query_id, vector[, radius]) with each ball that they may find something in, and their distance from its pivot: the `first` nearest, or those in reach of their radius."""
    lo, hi = reach.value
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            away = _distances(_units(part.column(1), pivots.value.shape[1]), pivots.value)
            if first is None:
                radius = part.column(2).to_numpy(zero_copy_only=False)[:, None]
                q, ball = np.nonzero((away - hi[None, :] <= radius) & (lo[None, :] - away <= radius))
            else:
                ball = np.argsort(away, axis=1, kind="stable")[:, :first].ravel()
                q = np.repeat(np.arange(len(away)), min(first, away.shape[1]))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(q)), pa.array(ball.astype(np.int32)), pa.array(away[q, ball])], names=["query_id", "ball", "away"])


def _products(queries: pa.Table, vectors: pa.Table, k: int, digits: int | None) -> pa.Table:
    """All queries of a group against all its vectors: the k best of each."""
    kinds = [queries.schema.field("query_id"), vectors.schema.field("chunk_id"), pa.field("score", pa.float64())]
    if not len(queries) or not len(vectors):
        return pa.table([pa.array([], f.type) for f in kinds], schema=pa.schema(kinds))
    # rows in order of their ids, so that of equal scores the first are those of the smallest ids
    vectors = vectors.sort_by("chunk_id")
    wanted, rows = (unit_rows(rows_of(t["vector"])[0]) for t in (queries, vectors))
    scores = wanted @ rows.T
    if digits is not None:
        scores = np.round(scores, digits) + 0.0
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    q = np.repeat(np.arange(len(wanted)), best.shape[1])
    return pa.table([queries["query_id"].take(pa.array(q)), vectors["chunk_id"].take(pa.array(best.ravel())), pa.array(scores[q, best.ravel()])], schema=pa.schema(kinds))


def _met(index: MetricIndex, queries: DataFrame, visits: DataFrame, k: int, digits: int | None) -> DataFrame:
    """queries (query_id, vector) and the rings they visit (query_id, ball, ring) to the k best of each query and ring."""
    asked = visits.groupBy("ball", "ring").agg(F.count("*").alias("asked")).withColumn("parts", F.ceil(F.col("asked") / QUERY_BLOCK).cast("int")).drop("asked")
    parted = visits.join(asked, ["ball", "ring"]).select("query_id", "ball", "ring", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"))
    left = queries.join(parted, "query_id").select("ball", "ring", "part", "query_id", "vector")
    copies = index.table("vectors").join(asked, ["ball", "ring"]).select("ball", "ring", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "chunk_id", "vector")
    kinds = queries.schema["query_id"].dataType.simpleString(), copies.schema["chunk_id"].dataType.simpleString()
    return left.groupBy("ball", "ring", "part").cogroup(copies.groupBy("ball", "ring", "part")).applyInArrow(functools.partial(_products, k=k, digits=digits), f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")


def visited(index: MetricIndex, queries: DataFrame, k: int, *, digits: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rings that queries of some length visit first, what they find there, and the rings that they visit then."""
    spark, matrix = index.spark, index.pivots()
    pivots = spark.sparkContext.broadcast(matrix)
    bounds = index.table("rings").groupBy("ball").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("ball").collect()  # one row a pivot
    lo, hi = np.full(len(matrix), np.inf), np.full(len(matrix), -np.inf)
    for r in bounds:
        lo[r["ball"]], hi[r["ball"]] = r["lo"], r["hi"]
    reach, rings = spark.sparkContext.broadcast((lo, hi)), index.table("rings")
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, ball int, away double"

    def balls(rows: DataFrame, first: int | None) -> DataFrame:
        return rows.mapInArrow(functools.partial(_near_balls, pivots=pivots, reach=reach, first=first), schema)

    gap = F.greatest(F.col("away") - F.col("hi"), F.col("lo") - F.col("away"), F.lit(0.0))
    nearest = Window.partitionBy("query_id", "ball").orderBy(gap, "ring")
    first = balls(queries, FIRST_BALLS).join(rings, "ball").withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= FIRST_RINGS).select("query_id", "ball", "ring")
    found = _met(index, queries, first, k, digits)
    slack = 1e-9 if digits is None else 10.0**-digits
    least = top_k(found, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    radius = F.sqrt(F.greatest(2 - 2 * (F.col("least") - slack), F.lit(0.0))) + 1e-7
    # with fewer than k found so far, nothing is out of reach
    bounded = queries.join(least, "query_id", "left").select("query_id", "vector", F.when(F.col("least").isNull(), 2.1).otherwise(radius).alias("radius"))
    within = balls(bounded, None).join(bounded.select("query_id", "radius"), "query_id").join(rings, "ball").filter(gap <= F.col("radius"))
    then = within.select("query_id", "ball", "ring").join(first, ["query_id", "ball", "ring"], "left_anti")
    return first, found, then


def metric_search(index: MetricIndex, queries: DataFrame, k: int, *, digits: int | None = None) -> DataFrame:
    """queries (query_id, vector) to their k nearest, (query_id, chunk_id, score, rank)."""
    asked = queries.select("query_id", "vector")
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    some = F.coalesce(F.sqrt(length), F.lit(0.0)) > TINY
    nothing = F.lit(0.0).alias("score")
    # whatever scores 0 by rule: k ids are all that can be needed of them
    odd = index.table("odd").orderBy("chunk_id").limit(k)
    names = index.table("vectors").select("chunk_id").unionByName(index.table("odd")).orderBy("chunk_id").limit(k)
    out = asked.filter(some).select("query_id").crossJoin(F.broadcast(odd)).unionByName(asked.filter(~some).select("query_id").crossJoin(F.broadcast(names))).select("query_id", "chunk_id", nothing)
    if not index.table("rings").isEmpty():
        _, found, then = visited(index, asked.filter(some), k, digits=digits)
        out = out.unionByName(found).unionByName(_met(index, asked.filter(some), then, k, digits))
    return top_k(out, k)
