"""What a stream tells while it runs: a listener that passes on how long each batch took, and how the query ended."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

class Progress(StreamingQueryListener):
    """Calls `tell` with a dict for each batch of one query that had rows: batch, seconds; and when the query ends: ended, error.

    Rows are not counted here: a batch function that reads its batch twice makes Spark count them twice.
    """

    def __init__(self, spark: SparkSession, tell: Callable[[dict], None]) -> None:
        self.spark, self.tell, self.run, self.ended = spark, tell, None, threading.Event()

    def follow(self, start: Callable[[], StreamingQuery]) -> StreamingQuery:
        """Starts a query and listens to it, and to no other, until it ends."""
        self.spark.streams.addListener(self)
        query = start()
        self.run = str(query.runId)
        return query

    def _mine(self, run: object) -> bool:
        return self.run is None or str(run) == self.run

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        if self._mine(p.runId) and p.numInputRows:
            self.tell({"batch": p.batchId, "seconds": p.batchDuration / 1000})

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        if self._mine(event.runId):
            self.tell({"ended": True, "error": event.exception})
            self.ended.set()
            threading.Thread(target=self.spark.streams.removeListener, args=(self,), daemon=True).start()
