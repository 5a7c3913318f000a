"""Streams: documents that arrive in a folder of a table, and the events that tell how sources fare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.embedding import Embedder
from ..plans.ingest import ingest
from ..plans.store import Store
from ..sources.readers import read_texts
from .progress import Progress


def stream_texts(spark: SparkSession, path: str, schema: str, *, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_stream(docs: DataFrame, store: Store, source_id: str, embedder: Embedder, checkpoint: str, *, once: bool = True, on_progress: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Every batch of a stream (path, text) goes through the same change detection as a batch ingest. on_progress hears of each batch while the stream runs: the figures of its ingest once they are committed, then what Progress tells.

    A batch that is run again after a failure changes nothing: its documents are known by then with the same hashes.
    """
    def each(batch: DataFrame, number: int) -> None:
        summary = ingest(store, source_id, read_texts(batch), embedder)
        if on_progress is not None:
            on_progress({"batch": number} | vars(summary))

    writer = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    start = (writer.trigger(availableNow=True) if once else writer).start
    return start() if on_progress is None else Progress(docs.sparkSession, on_progress).follow(start)


def progress(documents: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Per document of a source its index from 0, the total, and percent done before it."""
    own = Window.partitionBy(source)
    rows = documents.withColumn("index", F.row_number().over(own.orderBy(*order)) - 1).withColumn("total", F.count("*").over(own))
    return rows.withColumn("percent", F.round(100.0 * F.col("index") / F.col("total"), 0).cast("int"))


def latest_status(events: DataFrame, key: str, sequence: str) -> DataFrame:
    """Folds events (key, kind in progress, syncing, done, failed) to each key's status.

    Progress makes a source ingesting unless it is syncing; done and failed end both.
    """
    last = F.max_by("kind", sequence)
    ended = F.max(F.when(F.col("kind").isin("done", "failed"), F.col(sequence)))
    syncing = F.max(F.when(F.col("kind") == "syncing", F.col(sequence)))
    folded = events.groupBy(key).agg(last.alias("last"), ended.alias("ended"), syncing.alias("syncing"))
    status = F.when(F.col("last") == "done", "ready").when(F.col("last") == "failed", "error").when(F.coalesce(F.col("syncing") > F.col("ended"), F.col("syncing").isNotNull()), "syncing").otherwise("ingesting")
    return folded.select(key, status.alias("status"))


def open_tabs(events: DataFrame, viewer: str, item: str, sequence: str) -> DataFrame:
    """Folds events (viewer, item, kind open or close) to the tabs that are open: an item once, in the order in which it was last opened anew.

    Opening an item that is open changes nothing but which tab is active: the one opened last.
    """
    per = Window.partitionBy(viewer, item).orderBy(sequence)
    fresh = (F.col("kind") == "open") & (F.coalesce(F.lag("kind").over(per), F.lit("close")) == "close")
    folded = events.withColumn("anew", F.when(fresh, F.col(sequence))).groupBy(viewer, item).agg(F.max_by("kind", sequence).alias("last"), F.max("anew").alias("since"), F.max(F.when(F.col("kind") == "open", F.col(sequence))).alias("touched"))
    order, touched = Window.partitionBy(viewer).orderBy("since"), Window.partitionBy(viewer)
    return folded.filter("last = 'open'").select(viewer, item, F.row_number().over(order).alias("tab"), (F.col("touched") == F.max("touched").over(touched)).alias("active"))


def ticks(spark: SparkSession, interval_ms: int, count: int) -> DataFrame:
    """A bounded stream of ticks; an interval below 16 ms counts as 16."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", max(16, interval_ms)).load().filter(F.col("value") < count)
