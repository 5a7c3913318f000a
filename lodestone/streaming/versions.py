"""Change detection as a stream's state: of each path of a source, which text it had last, and how many it has had.

    source_id, path -> content_hash, modified, version      the state of a key, in RocksDB under the checkpoint

A row whose text is the one known says nothing; another one comes out as `new` or `changed` with the next version. Rows that
are older than what is known are late and say nothing. Of a key's rows in one batch the newest counts, then the
largest hash. With gone_after_ms, a path that no batch has had for so long comes out as `gone` and is forgotten, by a timer.

Rows without a path or text are passed over. A stream that is started again from its checkpoint goes on from its state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import content_hash

STATE = "content_hash string, modified_us bigint, version bigint"
CHANGES = "source_id string, path string, status string, version bigint, content_hash string, text string"
CHANGE = Row(*(c.split()[0] for c in CHANGES.split(", ")))
#: State with timers and a schema needs this store; a query takes the setting when it starts.
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Versions(StatefulProcessor):
    """The state of one path, and what its rows say."""

    def __init__(self, gone_after_ms: int | None = None) -> None:
        self.gone_after_ms = gone_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        newest = max(rows, key=lambda r: (r.modified_us, r.content_hash))
        modified, digest, text = newest.modified_us, newest.content_hash, newest.text
        had = self.known.get()  # None for a key that is new: to ask whether there is a state is a call more
        if self.gone_after_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gone_after_ms)
        if had is not None and modified < had[1]:
            return
        changed = had is None or had[0] != digest
        version = (0 if had is None else had[2]) + changed
        self.known.update((digest, int(modified), int(version)))
        if changed:
            yield CHANGE(*key, "new" if had is None else "changed", version, digest, text)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        digest, _, version = self.known.get()
        self.known.clear()
        yield CHANGE(*key, "gone", version + 1, digest, None)

    def close(self) -> None:
        pass


def versions(docs: DataFrame, gone_after_ms: int | None = None) -> DataFrame:
    """A stream (source_id, path, text, modified timestamp) to the stream of its changes (source_id, path, status, version, content_hash, text)."""
    rows = docs.filter("path is not null and text is not null").select("source_id", "path", "text", F.unix_micros("modified").alias("modified_us"), content_hash(F.col("text")).alias("content_hash"))
    mode = "None" if gone_after_ms is None else "ProcessingTime"
    return rows.groupBy("source_id", "path").transformWithState(Versions(gone_after_ms), CHANGES, "Append", mode)


def write_versions(docs: DataFrame, output: str, checkpoint: str, *, gone_after_ms: int | None = None, once: bool = True) -> StreamingQuery:
    """Starts a query that appends the changes to Parquet at output, each exactly once.

    Timers need a stream that goes on: with gone_after_ms a run over what is there now (once) would never come to an end.
    """
    if once and gone_after_ms is not None:
        raise ValueError("gone_after_ms needs once=False")
    conf = docs.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        writer = versions(docs, gone_after_ms).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


def latest(spark: SparkSession, output: str) -> DataFrame:
    """(source_id, path, version, content_hash, text) of the paths that are there now."""
    changes = spark.read.schema(CHANGES).parquet(output)
    last = changes.groupBy("source_id", "path").agg(F.max_by(F.struct("status", "version", "content_hash", "text"), "version").alias("c"))
    return last.select("source_id", "path", "c.*").filter("status <> 'gone'").drop("status")
