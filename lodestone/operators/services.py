"""Calls to services from tasks: several requests in flight, retries that wait longer each time, courtesy to hosts, and answers kept by request.

asked() takes a frame of requests and asks each distinct one once. Answers are appended to a table in a folder that all
executors share; a run that is started again, after a failure or for more requests, asks only what has no answer there.
"""

from __future__ import annotations

import functools
import threading
import time
import urllib.error
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWERS = "key string, request string, answer string, error string"


@dataclass(frozen=True)
class Manners:
    """How a task calls: requests in flight at most, in all and to one host; tries; seconds before the second try, doubled for each further one; seconds between two requests to one host."""

    in_flight: int = 8
    per_host: int = 8
    tries: int = 4
    wait: float = 0.5
    pause: float = 0.0


def host_of(request: str) -> str:
    return urlsplit(request).netloc


def passing(error: Exception) -> bool:
    """Whether another try may help: the connection failed, or the server is busy or broken."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code == 429 or error.code >= 500
    return isinstance(error, OSError)


class Caller:
    """Calls of one task. Only errors that are `passing` are tried again; the last one is raised."""

    def __init__(self, manners: Manners) -> None:
        self.manners, self.lock = manners, threading.Lock()
        self.gates: dict[str, threading.Semaphore] = {}
        self.free: dict[str, float] = {}

    def _turn(self, host: str) -> None:
        """Waits for this request's turn with the host."""
        with self.lock:
            now = time.monotonic()
            at = max(now, self.free.get(host, now))
            self.free[host] = at + self.manners.pause
        time.sleep(max(0.0, at - now))

    def one(self, call: Callable, request, host: str):  # noqa: ANN001, ANN201
        with self.lock:
            gate = self.gates.setdefault(host, threading.Semaphore(self.manners.per_host))
        for nth in range(self.manners.tries):
            if nth:
                time.sleep(self.manners.wait * 2 ** (nth - 1))
            try:
                with gate:
                    self._turn(host)
                    return call(request)
            except Exception as e:
                if nth == self.manners.tries - 1 or not passing(e):
                    raise

    def all(self, call: Callable, requests: list, host: Callable = lambda request: "") -> list:
        """(answer, error) for each request, in their order."""

        def safe(request) -> tuple:  # noqa: ANN001
            try:
                return self.one(call, request, host(request)), None
            except Exception as e:  # noqa: BLE001 - what went wrong is part of the answer
                return None, e

        with ThreadPoolExecutor(self.manners.in_flight) as pool:
            return list(pool.map(safe, requests))


def _ask(batches: Iterable[pa.RecordBatch], call: Callable[[str], str], manners: Manners, host: Callable[[str], str]) -> Iterator[pa.RecordBatch]:
    caller = Caller(manners)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = caller.all(call, part.column(1).to_pylist(), host)
            answers = [a for a, _ in found], [None if e is None else (str(e) or type(e).__name__) for _, e in found]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, pa.string()) for x in answers)], names=["key", "request", "answer", "error"])


def answers_at(requests: DataFrame, keep: str) -> DataFrame:
    """The answers that are kept there: of a key's rows, one with an answer if there is any."""
    spark = requests.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(keep)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], ANSWERS)
    best = F.min_by(F.struct("request", "answer", "error"), F.struct(F.col("answer").isNull(), "error"))
    return spark.read.schema(ANSWERS).parquet(keep).groupBy("key").agg(best.alias("a")).select("key", "a.*")


def asked(requests: DataFrame, call: Callable[[str], str], keep: str, *, manners: Manners | None = None, host: Callable[[str], str] | None = None, blocks: int = 1) -> DataFrame:
    """requests (request string) to (key, request, answer, error), a row for each distinct request that is not null; its key is its SHA-256.

    A request that failed has an error and no answer, and is asked again by the next run. blocks: in how many parts, by the
    requests' hashes, answers are committed; what a failed run has committed stays. host: with it, requests to one host come
    to one task, so that its limits hold for the whole run; a host is then asked no faster than one task asks it.
    """
    own, keyed = manners or Manners(), requests.select("request").filter("request is not null").distinct().withColumn("key", F.sha2("request", 256))
    for block in range(blocks):
        todo = keyed.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block) if blocks > 1 else keyed
        todo = todo.join(answers_at(requests, keep).filter("answer is not null").select("key"), "key", "left_anti").select("key", "request")
        if host is not None:
            todo = todo.withColumn("host", F.regexp_extract("request", "^[a-z]+://([^/?#]*)", 1)).repartition("host").select("key", "request")
        todo.mapInArrow(functools.partial(_ask, call=call, manners=own, host=host or (lambda request: "")), ANSWERS).write.mode("append").parquet(keep)
    return keyed.join(answers_at(requests, keep).drop("request"), "key").select("key", "request", "answer", "error")
