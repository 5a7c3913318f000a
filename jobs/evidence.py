"""Batch job: the evidence for a batch of questions, with what a citation needs.

    python jobs/evidence.py --questions hdfs:///questions --documents hdfs:///documents --output hdfs:///evidence

Documents are cut into chunks, chunks are ranked for each question by BM25, near copies of better chunks are left out, and
what fits a budget of tokens is packed in order of rank. Written, each by one overwrite of its own folder:

    output/chunks/part=SOURCE/...    the chunks, as an index for these questions and later ones reads them
    output/index/...                 their term counts
    output/evidence/part=SOURCE/...  query_id, rank, id, ordinal, char_start, char_end, score, cost, text
    output/questions/...             one row a question, those without evidence too: n_evidence, tokens

A rerun overwrites all four with the same rows.

Defined results: questions and documents without an id are left out, a null text counts as empty; of documents that repeat
an id the one with the largest text hash counts; a question without terms has no evidence; ties go by chunk id.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from jobs.common import command_line, parts, settings  # noqa: E402
from jobs.feed_chunks import CHUNK_TEXT  # noqa: E402
from lodestone import queries as library  # noqa: E402
from lodestone.functions.text import content_hash, estimate_tokens_by_words  # noqa: E402
from lodestone.operators.bm25 import MOST_TERMS, bm25_search, build_index  # noqa: E402
from lodestone.operators.chunking import chunk_documents  # noqa: E402
from lodestone.operators.fusion import drop_near_duplicates, hydrate, pack_skipping, signed  # noqa: E402
from lodestone.schemas import ChunkConfig  # noqa: E402

log = logging.getLogger("evidence")

CHUNKS = "chunk_id string, id string, ordinal int, char_start bigint, char_end bigint, token_count int, text string, part string"
EVIDENCE = "query_id string, rank int, id string, ordinal int, char_start bigint, char_end bigint, score double, cost bigint, text string, part string"
QUESTIONS = "query_id string, n_evidence bigint, tokens bigint"


def put(rows: DataFrame, at: str, schema: str, *by: str) -> int:
    """Overwrites what is there, and gives the number of rows."""
    wrote = Observation()
    columns = [F.col(name).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))]
    writer = rows.select(*columns).observe(wrote, F.count("*").alias("rows")).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(at)
    log.info("wrote %d rows to %s", wrote.get["rows"], at)
    return wrote.get["rows"]


def cut(documents: DataFrame, config: dict) -> DataFrame:
    """documents (id, text, part) to chunks. Texts cross one shuffle, by part; those whose id repeats are told apart first."""
    hashed = documents.filter("id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    repeated = hashed.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    if n := repeated.limit(MOST_TERMS + 1).count():
        some = F.broadcast(repeated) if n <= MOST_TERMS else repeated
        again = hashed.join(some, "id", "left_semi").withColumn("h", content_hash(F.col("text")))
        one = again.groupBy("id").agg(F.max(F.struct("h", "part")).alias("d")).select("id", "d.*")
        copies = again.drop("part").join(one, ["id", "h"]).dropDuplicates(["id"]).drop("h")
        hashed = hashed.join(some, "id", "left_anti").unionByName(copies)
    texts = hashed.select("id", "text", "part", F.lit("plain").alias("kind")).hint("rebalance", "part")
    cut = chunk_documents(texts, ChunkConfig(max_tokens=config["max_tokens"], overlap_tokens=config["overlap_tokens"]), document_id="id", kind="kind", keep=("part",))
    return cut.select(F.col("id").alias("chunk_id"), F.col("document_id").alias("id"), "ordinal", "locator.char_start", "locator.char_end", "token_count", "text", "part")


def run(spark: SparkSession, questions: str, documents: str, output: str, config: dict | None = None) -> dict[str, int]:
    """questions (item_id, text) and documents (doc_id, text, source) to evidence. Gives the number of rows of each output."""
    c, figures, read = settings("evidence", config), {}, Observation()
    asked = spark.read.parquet(questions).select(F.col("item_id").cast("string").alias("query_id"), F.coalesce("text", F.lit("")).alias("text")).filter("query_id is not null").dropDuplicates(["query_id"])
    docs = spark.read.parquet(documents).select(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").cast("string").alias("part"))
    figures["chunks"] = put(cut(docs, c), f"{output}/chunks", CHUNKS, "part")
    chunks = parts(spark, f"{output}/chunks", CHUNKS)
    index = build_index(chunks, f"{output}/index")
    found = bm25_search(index, asked, c["k"], digits=6).persist(StorageLevel.DISK_ONLY)  # k rows a question, for two uses
    few = F.broadcast if found.count() <= MOST_TERMS else lambda rows: rows  # then no chunk is shuffled to find theirs
    known = signed(few(found.select("chunk_id").distinct()), chunks, estimate_tokens_by_words(F.col("text")).alias("price"))
    kept = pack_skipping(drop_near_duplicates(found.join(known, "chunk_id"), c["dedup_threshold"]), c["budget"], F.col("price"))
    figures["evidence"] = put(hydrate(few(kept.select("query_id", "rank", "chunk_id", "score", "cost")), chunks).hint("rebalance", "part"), f"{output}/evidence", EVIDENCE, "part")
    found.unpersist()
    evidence = parts(spark, f"{output}/evidence", EVIDENCE)
    told = evidence.groupBy("query_id").agg(F.count("*").alias("n_evidence"), F.sum("cost").alias("tokens"))
    summary = asked.observe(read, F.count("*").alias("n")).select("query_id").join(told, "query_id", "left").fillna(0, ["n_evidence", "tokens"])
    figures["questions"] = put(summary, f"{output}/questions", QUESTIONS)
    log.info("read %d questions of %s and the documents of %s", read.get["n"], questions, documents)
    return figures


def job2_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence for the benchmark's items in the whole documents, written twice."""
    at = library.shared(spark)
    for _ in range(2):
        run(spark, f"{sf_dir}/benchmark.parquet", f"{sf_dir}/documents.parquet", at)
    rows, asked = parts(spark, f"{at}/evidence", EVIDENCE), parts(spark, f"{at}/questions", QUESTIONS)
    each = asked.join(rows.drop("text"), "query_id", "left")
    return each.select(F.col("query_id").cast("long").alias("query_id"), "n_evidence", "tokens", "rank", F.col("id").cast("long").alias("doc_id"), "ordinal", "char_start", "char_end", "score", "cost", F.col("part").alias("source"))


#: The library's SQL for ranking, near copies and packing, over chunks in place of documents.
_CHUNKS = f"chunked AS MATERIALIZED (SELECT doc_id::VARCHAR || '#' || lpad(ordinal::VARCHAR, 8, '0') AS doc_id, doc_id AS own_id, source, ordinal, char_start, char_end, {CHUNK_TEXT} AS text FROM ({library.SQL_CHUNKS}) JOIN documents USING (doc_id))"
_RANKED = library.SQL_BM25.replace("FROM documents)", "FROM chunked)", 1) + ", ranked AS (SELECT * FROM lexical)"
JOB2_SQL = f"""{library.sql_deduped(_RANKED).replace("WITH RECURSIVE d AS", f"WITH RECURSIVE {_CHUNKS}, d AS", 1)},
priced AS (SELECT query_id, rank, chunk_id, score, own_id, ordinal, char_start, char_end, source, {library.WORD_COST} AS cost FROM ranked JOIN kept USING (query_id) JOIN chunked ON doc_id = chunk_id WHERE list_contains(kept.taken, rank)),
packed AS (SELECT query_id, list_reduce(list_prepend({{'used': 0::BIGINT, 'cost': 0::BIGINT, 'rank': 0, 'taken': []::INT[]}}, list({{'used': 0::BIGINT, 'cost': cost, 'rank': rank, 'taken': []::INT[]}} ORDER BY rank)),
  lambda a, x: CASE WHEN x.cost > 0 AND a.used + x.cost <= {settings("evidence")["budget"]} THEN {{'used': a.used + x.cost, 'cost': 0::BIGINT, 'rank': 0, 'taken': list_append(a.taken, x.rank)}} ELSE a END).taken AS taken FROM priced GROUP BY query_id),
evidence AS (SELECT priced.* FROM priced JOIN packed USING (query_id) WHERE list_contains(packed.taken, rank))
SELECT item_id AS query_id, count(e.rank) OVER (PARTITION BY item_id) AS n_evidence, coalesce(sum(cost) OVER (PARTITION BY item_id), 0)::BIGINT AS tokens, rank, own_id AS doc_id, ordinal, char_start, char_end, score, cost, nullif(source, '') AS source
FROM benchmark LEFT JOIN evidence e ON e.query_id = item_id"""

if __name__ == "__main__":
    command_line(run, __doc__.splitlines()[0], "questions", "documents", "output")
