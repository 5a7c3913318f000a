"""Retrieval: vector and hybrid, for batches of queries (query_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens_by_words
from ..operators.bm25 import Bm25Index, bm25_search, build_index
from ..operators.embedding import Embedder
from ..operators.fusion import drop_near_duplicates, hydrate, pack_skipping, rrf, signed
from ..operators.segments import SegmentedIndex, block_search
from ..schemas import HybridConfig
from .vectors import FrameVectors, VectorStore


#: Most hits that a search gives.
SEARCH_MOST = 50


def clamped(k: int | Column) -> int | Column:
    """How many hits a search gives when asked for k: 1 to SEARCH_MOST."""
    return F.greatest(F.least(k, F.lit(SEARCH_MOST)), F.lit(1)) if isinstance(k, Column) else max(1, min(k, SEARCH_MOST))


def retrieve(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | VectorStore, embedder: Embedder, k: int, *, digits: int | None = None) -> DataFrame:
    """The k nearest chunks of each query by cosine, hydrated: query_id, rank, chunk_id, score and chunks' columns."""
    asked = queries.select("query_id", embedder.vectors(F.col("text")).alias("vector"))
    return hydrate(_held(vectors).search(asked, k, digits=digits), chunks)


def _held(vectors: DataFrame | VectorStore) -> VectorStore:
    return FrameVectors(vectors) if isinstance(vectors, DataFrame) else vectors


def hybrid_candidates(queries: DataFrame, vectors: DataFrame | VectorStore, index: Bm25Index | SegmentedIndex, embedder: Embedder, config: HybridConfig, *, digits: int | None = None) -> DataFrame:
    """Both arms fused: query_id, chunk_id, rrf, rank, and each arm's own score, null where the arm did not return the chunk."""
    asked = queries.select("query_id", embedder.vectors(F.col("text")).alias("vector"))
    near = _held(vectors).search(asked, config.per_arm_k, digits=digits)
    lexical = (block_search if isinstance(index, SegmentedIndex) else bm25_search)(index, queries, config.per_arm_k, digits=digits)
    return rrf(arms(near, lexical), config.rrf_k, carry=("cosine", "bm25"), digits=digits)


def arms(near: DataFrame, lexical: DataFrame) -> DataFrame:
    """Both arms' lists, one below the other, each arm's score in a column of its own."""
    none = F.lit(None).cast("double")
    return near.select("query_id", "chunk_id", "rank", F.col("score").alias("cosine"), none.alias("bm25")).unionByName(lexical.select("query_id", "chunk_id", "rank", none.alias("cosine"), F.col("score").alias("bm25")))


def retrieve_hybrid(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | VectorStore, embedder: Embedder, config: HybridConfig | None = None, *, index: Bm25Index | SegmentedIndex | None = None, digits: int | None = None) -> DataFrame:
    """Fused, without near duplicates, packed to the budget, and hydrated.

    Each chunk that is anyone's candidate is signed and priced once, on the chunks' side; lists carry ids, and texts are joined to what is left.
    """
    c = config or HybridConfig()
    found = hybrid_candidates(queries, vectors, index or build_index(chunks), embedder, c, digits=digits)
    known = signed(found.select("chunk_id").distinct(), chunks, estimate_tokens_by_words(F.col("text")).alias("price"))
    kept = drop_near_duplicates(found.join(known, "chunk_id"), c.dedup_threshold)
    return hydrate(pack_skipping(kept, c.budget, F.col("price")).drop("price"), chunks)
