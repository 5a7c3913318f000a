"""Incremental job: documents that arrive in a folder, to chunks that a retrieval index reads.

    python jobs/feed_chunks.py --input hdfs:///feed/documents --output hdfs:///corpus --checkpoint hdfs:///corpus-checkpoint

The input is a folder of Parquet files, or a pattern of folders and files (id, text, and a column to partition by, such as
the source). A run takes the files that no earlier run took (a file stream with a checkpoint) and ends when they are done. Documents whose text is the one
already known are passed over; new and changed ones are cut into windows of tokens and written:

    output/chunks/batch=N/part=SOURCE/...    chunks of the documents that batch N brought, or changed
    output/documents/batch=N/...             one row for each of them: id, content_hash, status, n_chunks

current() is what a reader takes: of each document the chunks of its newest batch.

Reruns: a batch that is run again, after a failure or from the checkpoint, overwrites its own partitions only and compares
with earlier batches only, so it writes the same rows again. A run without new files writes nothing.

Defined results: of several texts of one id in a batch the one in the newest file counts, then the largest hash; rows
without an id or without a text are counted in the log and leave what is known as it is; an empty text takes the
document's chunks away; a null partition value stays null, an empty one reads back as null; a document that comes with the
same text from another source stays where it is. An output that another checkpoint has taken further is an error.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from jobs.common import command_line, parts, settings  # noqa: E402
from lodestone import queries as library  # noqa: E402
from lodestone.functions.text import content_hash  # noqa: E402
from lodestone.operators.chunking import chunk_documents  # noqa: E402
from lodestone.plans.ingest import changes  # noqa: E402
from lodestone.schemas import ChunkConfig  # noqa: E402

log = logging.getLogger("feed_chunks")

#: What is written, partition columns last.
DOCUMENTS = "id string, content_hash string, status string, n_chunks bigint, batch int"
CHUNKS = "id string, ordinal int, char_start bigint, char_end bigint, token_count int, structural_path string, text string, batch int, part string"


def newest(documents: DataFrame) -> DataFrame:
    """One row for each id: what its newest batch knew of it."""
    return documents.groupBy("id").agg(F.max_by(F.struct("content_hash", "batch"), "batch").alias("d")).select("id", "d.*")


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of each document's newest batch."""
    last = newest(parts(spark, f"{output}/documents", DOCUMENTS)).select("id", "batch")
    return parts(spark, f"{output}/chunks", CHUNKS).join(last, ["id", "batch"]).drop("batch")


def put(rows: DataFrame, at: str, *by: str) -> None:
    """Overwrites the partitions that rows have, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(at)


def take(batch: DataFrame, number: int, output: str, config: dict) -> dict[str, int]:
    """Writes what a batch (id, text, part, modified) brings, and gives its figures."""
    spark, hashed = batch.sparkSession, batch.withColumn("content_hash", content_hash(F.col("text")))
    whole = F.col("id").isNotNull() & F.col("text").isNotNull()
    known = parts(spark, f"{output}/documents", DOCUMENTS)
    if (last := known.agg(F.max("batch")).first()[0]) is not None and last > number:
        raise ValueError(f"{output} has batch {last}, and the checkpoint is at batch {number}: it belongs to another output")
    before = newest(known.filter(F.col("batch") < number))

    def found(rows: DataFrame) -> DataFrame:
        """New and changed documents. Ids and hashes alone are compared; texts move once it is known which."""
        one = rows.filter(whole).groupBy("id").agg(F.max(F.struct("modified", "content_hash", "part")).alias("d")).select("id", "d.content_hash", "d.part")
        return changes(one, before, ["id"]).filter("status <> 'unchanged'")

    texts = hashed.select("id", "content_hash", "text").join(found(hashed), ["id", "content_hash"]).dropDuplicates(["id"])
    kinds = texts.select("id", "text", F.lit(config["text_kind"]).alias("kind"))
    cut = chunk_documents(kinds, ChunkConfig(max_tokens=config["max_tokens"], overlap_tokens=config["overlap_tokens"]), document_id="id", kind="kind")
    placed = cut.select(F.col("document_id").alias("id"), "ordinal", "locator.char_start", "locator.char_end", "token_count", "structural_path", "text")
    wrote = Observation()
    rows = placed.join(found(hashed).select("id", "part"), "id").withColumn("batch", F.lit(number)).select(*(c.split()[0] for c in CHUNKS.split(", ")))
    rows = rows.observe(wrote, F.count("*").alias("chunks_written"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens_written"))
    put(rows.hint("rebalance", "part"), f"{output}/chunks", "batch", "part")

    counts = parts(spark, f"{output}/chunks", CHUNKS).filter(F.col("batch") == number).groupBy("id").agg(F.count("*").alias("n_chunks"))
    read, told = Observation(), Observation()
    again = hashed.observe(read, F.count("*").alias("rows_read"), F.count_if(~whole).alias("rows_failed"))
    done = found(again).join(counts, "id", "left").select("id", "content_hash", "status", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.lit(number).alias("batch"))
    done = done.observe(told, F.count_if(F.col("status") == "new").alias("documents_new"), F.count_if(F.col("status") == "changed").alias("documents_changed"))
    put(done, f"{output}/documents", "batch")
    return read.get | told.get | wrote.get


FIGURES = ("rows_read", "rows_failed", "documents_new", "documents_changed", "chunks_written", "tokens_written")


def run(spark: SparkSession, input: str, output: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Takes what is new in the input and ends. Gives the figures of all batches of this run."""
    c, total = settings("feed_chunks", config), dict.fromkeys(("batches", *FIGURES), 0)

    def each(batch: DataFrame, number: int) -> None:
        figures = take(batch, number, output, c)
        log.info("batch %d of %s: %s", number, input, ", ".join(f"{k} {figures[k]}" for k in FIGURES))
        for k in FIGURES:
            total[k] += figures[k]
        total["batches"] += 1

    files = spark.readStream.schema(c["schema"]).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(input)
    columns = [F.col(c["id"]).cast("string").alias("id"), F.col(c["text"]).alias("text"), F.col(c["partition"]).cast("string").alias("part"), F.col("_metadata.file_modification_time").alias("modified")]
    query = files.select(*columns).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d rows of %s in %d batches, wrote %d chunks of %d new and %d changed documents to %s", total["rows_read"], input, total["batches"], total["chunks_written"], total["documents_new"], total["documents_changed"], output)
    return total


def job1_feed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents, taken by two runs, the second of which finds nothing new."""
    at = library.shared(spark)
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet*", f"{at}/output", f"{at}/checkpoint")
    return current(spark, f"{at}/output").select(F.col("id").cast("long").alias("doc_id"), F.col("part").alias("source"), "ordinal", "char_start", "char_end", "token_count", F.sha2("text", 256).alias("text_sha256"))


#: A chunk's text is what lies between its ends, without white space around it.
CHUNK_TEXT = r"regexp_replace(decode(encode(text)[char_start + 1:char_end]), '^[\s\x0b\x85\p{Z}]+|[\s\x0b\x85\p{Z}]+$', '', 'g')"
JOB1_SQL = f"SELECT doc_id, nullif(source, '') AS source, ordinal, char_start, char_end, token_count, sha256({CHUNK_TEXT}) AS text_sha256 FROM ({library.SQL_CHUNKS}) JOIN documents USING (doc_id)"

if __name__ == "__main__":
    command_line(run, __doc__.splitlines()[0], "input", "output", "checkpoint")
