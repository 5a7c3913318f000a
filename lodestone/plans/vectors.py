"""Where vectors live: what a retrieval needs of such a place, and the one that a workspace's store is."""

from __future__ import annotations

from typing import Protocol

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators import inverted_file
from ..operators.bm25 import top_k
from ..operators.vector_search import cosine_search
from .store import Store


class VectorStore(Protocol):
    def upsert(self, records: DataFrame) -> None:
        """Rows (chunk_id, document_id, vector); a chunk's newest vector counts."""

    def search(self, queries: DataFrame, k: int, *, digits: int | None = None) -> DataFrame:
        """queries (query_id, vector) to their k nearest: (query_id, chunk_id, score, rank)."""

    def delete_document(self, document_ids: DataFrame) -> None:
        """Rows (document_id): all their vectors go."""


class StoreVectors:
    """The chunk_vector table of a store, searched exactly."""

    def __init__(self, store: Store) -> None:
        self.store = store

    def upsert(self, records: DataFrame) -> None:
        self.store.upsert("chunk_vector", records.withColumn("dim", F.size("vector")))

    def search(self, queries: DataFrame, k: int, *, digits: int | None = None) -> DataFrame:
        return cosine_search(self.store.read("chunk_vector"), queries, k, digits=digits)

    def delete_document(self, document_ids: DataFrame) -> None:
        gone = self.store.read("chunk_vector").join(document_ids.select("document_id"), "document_id", "left_semi").select("chunk_id")
        self.store.commit(deleted={"chunk_vector": gone})


class FrameVectors:
    """Vectors (chunk_id, vector) of any frame, to be searched only."""

    def __init__(self, vectors: DataFrame) -> None:
        self.vectors = vectors

    def upsert(self, records: DataFrame) -> None:
        raise NotImplementedError("these vectors are read only")

    def search(self, queries: DataFrame, k: int, *, digits: int | None = None) -> DataFrame:
        return cosine_search(self.vectors, queries, k, digits=digits)

    def delete_document(self, document_ids: DataFrame) -> None:
        raise NotImplementedError("these vectors are read only")


class InvertedFileVectors:
    """Vectors in an inverted file with product-quantised codes: approximate, with exact=True or for what codes can't hold exact.

    Tables under path, written by Spark only: rows (chunk_id, document_id, vector, list, block, code) and gone (chunk_id), both by
    generation. An upsert or a deletion is one more generation; a row is stale once a later generation has its chunk
    in `gone`. The first upsert fits the codebook. One writer at a time; readers see a generation when its rows are written.
    """

    def __init__(self, spark: SparkSession, path: str, *, probes: int = inverted_file.PROBES, refine: int = inverted_file.REFINE) -> None:
        self.spark, self.path, self.probes, self.refine = spark, path.rstrip("/"), probes, refine

    def _exists(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _generation(self) -> int:
        found = [self.spark.read.parquet(f"{self.path}/{name}").agg(F.max("generation")).first()[0] for name in ("rows", "gone") if self._exists(name)]
        return max((g for g in found if g is not None), default=-1) + 1

    def _put(self, rows: DataFrame, name: str, generation: int) -> None:
        rows.withColumn("generation", F.lit(generation)).write.mode("append").partitionBy("generation").parquet(f"{self.path}/{name}")

    def live(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/rows")
        if not self._exists("gone"):
            return rows
        last = self.spark.read.parquet(f"{self.path}/gone").groupBy(F.col("chunk_id").alias("own")).agg(F.max("generation").alias("by"))
        return rows.join(last, (F.col("chunk_id") == F.col("own")) & (F.col("generation") < F.col("by")), "left_anti")

    def _book(self) -> Broadcast:
        return self.spark.sparkContext.broadcast(inverted_file.load(self.spark, f"{self.path}/codebook"))

    def upsert(self, records: DataFrame) -> None:
        """Rows (chunk_id, document_id, vector) that replace those of their chunks; rows that repeat a chunk in one batch must be equal."""
        own = records.select("chunk_id", "document_id", "vector").dropDuplicates(["chunk_id"])
        if not self._exists("codebook"):
            if (book := inverted_file.fit_sample(own)) is None:
                raise ValueError("no vector to fit a codebook to")
            inverted_file.save(self.spark, book, f"{self.path}/codebook")
        generation = self._generation()
        if generation:
            self._put(own.select("chunk_id"), "gone", generation)
        self._put(inverted_file.coded(own, self._book()), "rows", generation)

    def delete_document(self, document_ids: DataFrame) -> None:
        ids = self.live().select("chunk_id", "document_id").join(document_ids.select("document_id").distinct(), "document_id", "left_semi").select("chunk_id")
        self._put(ids, "gone", self._generation())

    def search(self, queries: DataFrame, k: int, *, digits: int | None = None, exact: bool = False, certain: bool = False) -> DataFrame:
        """With certain, codes leave out only what can't be among the k best: the result is exact for vectors that have a cosine and the codebook's dimension.

        Without exact and certain, vectors that have no cosine are not found, and others if their codes and list say that they are near."""
        rows = self.live()
        if exact:
            return cosine_search(rows.select("chunk_id", "vector"), queries, k, digits=digits)
        found = inverted_file.candidates(rows, queries, self._book(), k * self.refine, self.probes)
        pairs = found.join(rows.select("chunk_id", "vector"), "chunk_id").join(queries.select("query_id", F.col("vector").alias("asked")), "query_id")
        score = cosine(F.col("asked"), F.col("vector"))
        found = top_k(pairs.select("query_id", "chunk_id", (score if digits is None else F.round(score, digits) + 0.0).alias("score")), k)
        if not certain:
            return found
        least = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        return inverted_file.certain(rows, queries.select("query_id", "vector").join(least, "query_id", "left"), self._book(), k, digits)
