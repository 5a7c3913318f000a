"""A workspace: its store, its embedder and its model, and what a user does with them."""

from __future__ import annotations

import hashlib
import json
import subprocess
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..operators.embedding import Embedder, HashEmbedder
from ..operators.fusion import hydrate
from ..operators.models import BASE_URL, CHAT_MODEL, DIM, EMBED_MODEL, HttpEmbedder, HttpLlm, is_served
from ..operators.segments import SegmentedIndex, refreshed
from ..schemas import HybridConfig
from ..sources.folder_source import can_open
from ..sources.readers import cache_name, list_folder, read_folder, read_pages, read_texts, repo_cache_root, repo_error, repo_slug
from ..sources.web import fetch_pages
from .answering import Llm, MockLlm, answer, conversation_rows
from .ingest import IngestSummary, ingest
from .retrieval import clamped, retrieve_hybrid
from .store import Store
from .vectors import StoreVectors, VectorStore

ASK_HITS = 12
#: Where the store's settings name the index's segments and the state of the chunks that they stand for.
INDEX_KEY = "bm25_index"


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def ping() -> str:
    return "pong"


def version() -> str:
    return __version__


class Workspace:
    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, llm: Llm | None = None, vectors: VectorStore | None = None) -> None:
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark, path)
        self.embedder, self.llm = embedder or HashEmbedder(), llm or MockLlm()
        self.vectors = vectors or StoreVectors(self.store)

    @classmethod
    def open(cls, spark: SparkSession, path: str, *, base_url: str = BASE_URL, embed_model: str = EMBED_MODEL, chat_model: str = CHAT_MODEL, dim: int = DIM) -> Workspace:
        """With served models if a server answers at base_url, else with the hash embedder and the mock model."""
        if is_served(base_url):
            return cls(spark, path, HttpEmbedder(embed_model, dim, base_url), HttpLlm(chat_model, base_url))
        return cls(spark, path, HashEmbedder(dim), MockLlm())

    def _source(self, ident: str, kind: str, uri: str, status: str, synced: int | None = None, ingested: int | None = None) -> None:
        row = [(ident, kind, uri, status, ingested, synced, "{}")]
        self.store.upsert("source", self.spark.createDataFrame(row, "id string, kind string, uri string, status string, ingested_at bigint, last_synced_at bigint, meta string"))

    def _run(self, kind: str, uri: str, docs: Callable[[], tuple[DataFrame, DataFrame | None]], *, synced: bool = False) -> tuple[str, IngestSummary]:
        """docs: gives the documents, and the paths that should be among them. The source's id is a function of kind and uri: adding it again finds what is there."""
        ident = hashlib.sha256(f"{kind}\x01{uri}".encode()).hexdigest()
        self._source(ident, kind, uri, "ingesting")
        try:
            own, expected = docs()
            summary = ingest(self.store, ident, own, self.embedder, now_ms=now_ms(), expected=expected)
        except Exception as e:
            self._source(ident, kind, uri, "error")
            failed = self.spark.createDataFrame([(ident, now_ms(), "failed", "", str(e)[:1000])], "source_id string, at bigint, kind string, path string, outcome string")
            self.store.upsert("ingest_event", failed.select("*", *(F.lit(None).cast("long").alias(c) for c in IngestSummary.__dataclass_fields__)))
            raise
        self._source(ident, kind, uri, "ready", now_ms() if synced else None, now_ms())
        return ident, summary

    def _folder(self, root: str) -> tuple[DataFrame, DataFrame | None]:
        """What is under root, and what should be there where files that can't be read are missing."""
        return read_folder(self.spark, root, under=self.path), None if can_open(root) else list_folder(self.spark, root)

    def events(self, ident: str) -> DataFrame:
        """What a source's runs told, in order: a document at a time, and how each run ended."""
        return self.store.read("ingest_event").filter(F.col("source_id") == ident).orderBy("at", F.col("kind") != "progress", "path")

    def add_folder_source(self, root: str) -> tuple[str, IngestSummary]:
        return self._run("folder", root, lambda: self._folder(root))

    def add_url_source(self, uri: str, pages: DataFrame | None = None, *, synced: bool = False, **options) -> tuple[str, IngestSummary]:
        """pages (url, html), as a crawler left them; without them the page at uri is fetched."""
        return self._run("url", uri, lambda: self._pages(uri, pages, options), synced=synced)

    def _pages(self, uri: str, pages: DataFrame | None, options: dict) -> tuple[DataFrame, DataFrame | None]:
        if pages is not None:
            return read_pages(pages, **options), None
        wanted = self.spark.createDataFrame([(uri,)], "url string")
        # written at once: a page may read otherwise the next time
        fetch_pages(wanted).write.parquet(at := f"{self.path}/fetched/{uuid.uuid4().hex}")
        got = self.spark.read.parquet(at)
        return read_pages(got.filter("html is not null"), **options), wanted.withColumnRenamed("url", "path")

    def add_texts(self, uri: str, docs: DataFrame) -> tuple[str, IngestSummary]:
        return self._run("url", uri, lambda: (read_texts(docs), None))

    def add_repo_source(self, url: str, *, clone: bool = True, synced: bool = False) -> tuple[str, IngestSummary]:
        """Clones on the driver, in a folder of its own, puts the clone in the workspace, where all executors see it, and reads it as a folder."""
        one = self.spark.range(1).select(repo_slug(F.lit(url)).alias("slug"), repo_error(F.lit(url)).alias("error"), cache_name(repo_slug(F.lit(url))).alias("name")).first()
        if one["error"]:
            raise ValueError(f"{one['error']}: {url}")
        folder = f"{repo_cache_root(self.path)}/{one['name']}"
        if clone:
            with tempfile.TemporaryDirectory() as own:
                subprocess.run(["git", "clone", "--depth", "1", url, f"{own}/clone"], check=True, capture_output=True)
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
                fs = path(folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
                fs.delete(path(folder), True)
                fs.copyFromLocalFile(False, True, path(f"file://{own}/clone"), path(folder))
        return self._run("repo", url, lambda: self._folder(folder), synced=synced)

    def sync_source(self, ident: str, pages: DataFrame | None = None) -> IngestSummary:
        """Reads a source again. Its kind is checked first: only folders, repos and urls can be."""
        row = self.store.read("source").filter(F.col("id") == ident).first()
        if row is None:
            raise KeyError(ident)
        if row["kind"] == "folder":
            return self._run("folder", row["uri"], lambda: self._folder(row["uri"]), synced=True)[1]
        if row["kind"] == "repo":
            return self.add_repo_source(row["uri"], synced=True)[1]
        if row["kind"] == "url":
            return self.add_url_source(row["uri"], pages, synced=True)[1]
        raise ValueError(f"a source of kind {row['kind']} can't be synced")

    def chunks(self) -> DataFrame:
        own = self.store.read("document").select(F.col("id").alias("document_id"), "path_or_url", "title")
        return self.store.read("chunk").withColumnRenamed("id", "chunk_id").join(own, "document_id")

    def index(self) -> SegmentedIndex:
        """The index of the chunks as they are now. It is kept beside them; once they have changed, it takes a segment more, of what changed."""
        parts = self.store.state()["tables"].get("chunk", {"rows": [], "deleted": []})
        state = hashlib.sha256(json.dumps(parts).encode()).hexdigest()
        row = self.store.find("app_setting", self.spark.createDataFrame([(INDEX_KEY,)], "key string")).first()
        known = json.loads(row["value"]) if row else {"state": None, "segments": []}
        index = SegmentedIndex.open(self.spark, [f"{self.path}/index/{name}" for name in known["segments"]])
        if known["state"] == state:
            return index
        index = refreshed(index, self.chunks().select("chunk_id", "text"), f"{self.path}/index")
        value = json.dumps({"state": state, "segments": [p.rpartition("/")[2] for p in index.paths()]})
        self.store.upsert("app_setting", self.spark.createDataFrame([(INDEX_KEY, value)], "key string, value string"))
        return index

    def search(self, queries: DataFrame, k: int = ASK_HITS) -> DataFrame:
        asked = queries.select("query_id", self.embedder.vectors(F.col("text")).alias("vector"))
        return hydrate(self.vectors.search(asked, clamped(k)), self.chunks())

    def search_hybrid(self, queries: DataFrame, config: HybridConfig | None = None, index: SegmentedIndex | None = None) -> DataFrame:
        return retrieve_hybrid(queries, self.chunks(), self.vectors, self.embedder, config, index=index or self.index())

    def ask(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Answers and citations of a batch of questions (query_id, text); both are kept in the store."""
        hits = self.search(questions)
        answers, citations = answer(questions, hits, self.llm, f"{self.path}/answers/{uuid.uuid4().hex}")
        self.store.commit(conversation_rows(answers, citations, now_ms()), unique=True)
        return answers, citations
