"""Ingest: documents to chunks to vectors, only for what changed, committed together."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import chunk_documents
from ..operators.embedding import Embedder
from ..schemas import ChunkConfig
from .store import Store


@dataclass(frozen=True)
class IngestSummary:
    documents_ingested: int
    documents_skipped: int
    documents_failed: int
    chunks_created: int


def document_id(source_id: str | Column, path: Column) -> Column:
    """A function of source and path, so that a retry gives the same ids."""
    source = F.lit(source_id) if isinstance(source_id, str) else source_id
    return F.sha2(F.concat_ws("\u0001", source, path), 256)


def changes(incoming: DataFrame, known: DataFrame, keys: list[str], digest: str = "content_hash") -> DataFrame:
    """incoming with `status`: new, changed or unchanged against what is known under the keys."""
    old = known.select(*keys, F.col(digest).alias("_old"), F.lit(True).alias("_known"))
    status = F.when(F.col("_known").isNull(), "new").when(F.col("_old").eqNullSafe(F.col(digest)), "unchanged").otherwise("changed")
    return incoming.join(old, keys, "left").withColumn("status", status).drop("_old", "_known")


def tally(documents: DataFrame) -> DataFrame:
    """One row of totals over rows (status, n_chunks): a changed document without chunks is skipped, one without text failed."""
    done = F.col("status").isin("new", "changed") & (F.col("n_chunks") > 0)
    return documents.agg(
        F.count_if(done).alias("documents_ingested"),
        F.count_if(~done & (F.col("status") != "failed")).alias("documents_skipped"),
        F.count_if(F.col("status") == "failed").alias("documents_failed"),
        F.coalesce(F.sum(F.when(done, F.col("n_chunks"))), F.lit(0)).cast("long").alias("chunks_created"),
    )


def _version() -> Column:
    """A document with its hash and title as one key that is never null, and that nulls don't make ambiguous."""
    return F.concat("document_id", *(F.coalesce(F.concat(F.lit(mark), c), F.lit("")) for mark, c in (("h", "content_hash"), ("t", "title"))))


COLUMNS = ("path", "title", "mime", "text_kind", "byte_size", "content_hash")


def incoming(docs: DataFrame, known: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """One row for each path without its text: COLUMNS and status. Of rows that repeat a path the one with the smallest hash and title counts.

    A document without a text, and a path of `expected` that docs doesn't have, failed.
    """
    light = docs.select(*COLUMNS, F.col("text").isNull().alias("failed"))
    one = light.groupBy("path").agg(F.min(F.struct("content_hash", "title", "mime", "text_kind", "byte_size", "failed")).alias("d")).select("path", "d.*")
    found = changes(one, known, ["path"]).withColumn("status", F.when(F.col("failed"), "failed").otherwise(F.col("status"))).select(*COLUMNS, "status")
    if expected is None:
        return found
    missing = expected.select("path").distinct().join(docs.select("path"), "path", "left_anti")
    return found.unionByName(missing.withColumn("status", F.lit("failed")), allowMissingColumns=True)


def ingest(
    store: Store, source_id: str, docs: DataFrame, embedder: Embedder, config: ChunkConfig | None = None, *,
    now_ms: int | None = None, remove_missing: bool = False, expected: DataFrame | None = None, on_events: Callable[[DataFrame], None] | None = None,
) -> IngestSummary:
    """docs as the readers give them. Paths and hashes alone are held against what is known; only texts that changed are moved, cut and embedded.

    With remove_missing, documents of the source that docs no longer has are deleted. expected: the paths that should be
    there; those that docs lacks count as failed. The run's events are committed with its rows: one for each
    document that is not unchanged, and one that ends the run, with its totals; on_events gets them too.
    """
    base = store.version()
    old = store.read("document").filter(F.col("source_id") == source_id)
    known = old.select(F.col("path_or_url").alias("path"), "content_hash")
    stamp = now_ms if now_ms is not None else time.time_ns() // 1_000_000
    found = incoming(docs, known, expected).withColumn("document_id", document_id(source_id, F.col("path"))).persist(StorageLevel.DISK_ONLY)
    work = found.filter(F.col("status").isin("new", "changed")).select("document_id", _version().alias("version")).drop("document_id")
    # the texts of changed documents, found again by what was decided on: one shuffle by one key for the join and for rows that repeat
    texts = docs.withColumn("document_id", document_id(source_id, F.col("path"))).select("document_id", "text", "text_kind", _version().alias("version")).join(work, "version", "left_semi")
    chunks = chunk_documents(texts.dropDuplicates(["version"]), config).persist(StorageLevel.DISK_ONLY)
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    placed = found.join(counts, "document_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    total = tally(placed).first()
    summary = IngestSummary(*(total[c] for c in ("documents_ingested", "documents_skipped", "documents_failed", "chunks_created")))
    gone = placed.filter("status = 'changed'").select(F.col("document_id").alias("id"))
    if remove_missing:
        gone = gone.unionByName(old.join(docs.select(F.col("path").alias("path_or_url")), "path_or_url", "left_anti").select("id"))
    events = run_events(placed, source_id, summary, stamp)
    rows = {
        "document": placed.filter("status in ('new', 'changed') and n_chunks > 0").select(F.col("document_id").alias("id"), F.lit(source_id).alias("source_id"), F.col("path").alias("path_or_url"), "title", "mime", "byte_size", "content_hash", F.lit(None).cast("int").alias("page_count"), F.lit(stamp).alias("ingested_at")),
        "chunk": chunks,
        "embedding": chunks.select(F.col("id").alias("chunk_id"), F.lit(embedder.model_id).alias("model_id"), F.lit(embedder.dim).alias("dim")),
        "chunk_vector": chunks.select(F.col("id").alias("chunk_id"), "document_id", F.lit(embedder.dim).alias("dim"), embedder.vectors(F.col("text")).alias("vector")),
    }
    some_go = not gone.isEmpty()
    if summary.documents_ingested or some_go:
        store.commit(rows | {"ingest_event": events}, store.below("document", gone) if some_go else {}, unique=True, base=base, reads=("document",))
    else:
        store.commit({"ingest_event": events}, unique=True)
    if on_events:
        on_events(events)
    chunks.unpersist()
    found.unpersist()
    return summary


def run_events(documents: DataFrame, source_id: str, summary: IngestSummary, stamp: int) -> DataFrame:
    """ingest_event rows of a run: `progress` for each document that was ingested, skipped after a change, or failed, and `done`."""
    totals = [F.lit(v).cast("long").alias(c) for c, v in vars(summary).items()]
    none = [F.lit(None).cast("long").alias(c) for c in vars(summary)]
    outcome = F.when(F.col("status") == "failed", "failed").when(F.col("n_chunks") > 0, "ingested").otherwise("skipped")
    head = [F.lit(source_id).alias("source_id"), F.lit(stamp).cast("long").alias("at")]
    each = documents.filter("status <> 'unchanged'").select(*head, F.lit("progress").alias("kind"), "path", outcome.alias("outcome"), *none)
    done = documents.sparkSession.range(1).select(*head, F.lit("done").alias("kind"), F.lit("").alias("path"), F.lit(None).cast("string").alias("outcome"), *totals)
    return each.unionByName(done)
