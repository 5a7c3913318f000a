"""Tables of a workspace and the settings of its operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1

LOCATOR = "struct<kind: string, page: int, char_start: bigint, char_end: bigint, bbox: array<float>, line_start: bigint, line_end: bigint, start_seconds: double, end_seconds: double>"

TABLES = {
    "source": "id string, kind string, uri string, status string, ingested_at bigint, last_synced_at bigint, meta string",
    "document": "id string, source_id string, path_or_url string, title string, mime string, byte_size bigint, content_hash string, page_count int, ingested_at bigint",
    "chunk": f"id string, document_id string, ordinal int, text string, token_count int, structural_path string, locator {LOCATOR}",
    "embedding": "chunk_id string, model_id string, dim int",
    "chunk_vector": "chunk_id string, document_id string, dim int, vector array<float>",
    "conversation": "id string, title string, created_at bigint",
    "message": "id string, conversation_id string, role string, content string, created_at bigint",
    "citation": "message_id string, chunk_id string, retrieved_score double, used_in_answer boolean",
    "ingest_event": "source_id string, at bigint, kind string, path string, outcome string, documents_ingested bigint, documents_skipped bigint, documents_failed bigint, chunks_created bigint",
    "workspace": "id string, name string, dir string, icon string, created_at bigint",
    "app_setting": "key string, value string",
}

#: Keys that an upsert replaces.
KEYS = {
    "source": ["id"], "document": ["id"], "chunk": ["id"], "embedding": ["chunk_id"], "chunk_vector": ["chunk_id"],
    "conversation": ["id"], "message": ["id"], "citation": ["message_id", "chunk_id"], "ingest_event": ["source_id", "at", "kind", "path"], "workspace": ["id"], "app_setting": ["key"],
}

# The domains that the tables' checks allow.
SOURCE_KINDS = ("folder", "repo", "youtube", "pdf", "url")
SOURCE_STATUSES = ("queued", "ingesting", "ready", "error", "stale")
MESSAGE_ROLES = ("user", "assistant", "system")
DOMAINS = {"source": {"kind": SOURCE_KINDS, "status": SOURCE_STATUSES}, "message": {"role": MESSAGE_ROLES}}


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def violations(table: str) -> Column:
    """An array of the columns of a row whose value lies outside its domain."""
    checks = [F.when(F.coalesce(~F.col(c).isin(*allowed), F.lit(True)), F.lit(c)) for c, allowed in DOMAINS.get(table, {}).items()]
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


@dataclass(frozen=True)
class ChunkConfig:
    min_tokens: int = 300  # kept for its name; nothing reads it
    max_tokens: int = 500
    overlap_tokens: int = 50


@dataclass(frozen=True)
class Bm25Config:
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class HybridConfig:
    per_arm_k: int = 30
    rrf_k: int = 60
    dedup_threshold: float = 0.85
    budget: int = 6000
    reject_below: float = 0.15
