"""Versions of documents as a stream's state."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lodestone.streaming.versions import CHANGES, PROVIDER, latest, write_versions

SCHEMA = "source_id string, path string, text string"


def add(spark, folder, rows, at):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    for p in folder.glob("part-*.parquet"):
        if p.stat().st_mtime > 100_000:
            os.utime(p, (at, at))


def run(spark, tmp_path, **options):
    docs = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).select("*", F.col("_metadata.file_modification_time").alias("modified"))
    write_versions(docs, str(tmp_path / "out"), str(tmp_path / "checkpoint"), **options).awaitTermination()
    return sorted((r.source_id, r.path, r.version, r.text) for r in latest(spark, str(tmp_path / "out")).collect())


def changes(spark, tmp_path):
    return sorted((r.path, r.version, r.status) for r in spark.read.schema(CHANGES).parquet(str(tmp_path / "out")).collect())


def test_versions_and_restarts(spark, tmp_path):
    before = spark.conf.get(PROVIDER)
    add(spark, tmp_path / "in", [("s", "a", "one"), ("s", "b", "two"), ("t", "a", "other source"), ("s", "a", "zero"), ("s", None, "x"), ("s", "n", None)], 100)
    assert run(spark, tmp_path) == [("s", "a", 1, "zero" if content("zero") > content("one") else "one"), ("s", "b", 1, "two"), ("t", "a", 1, "other source")]
    assert spark.conf.get(PROVIDER) == before
    assert len(changes(spark, tmp_path)) == 3 and run(spark, tmp_path)[1] == ("s", "b", 1, "two")  # nothing new
    # from the checkpoint: unchanged, changed, new, and then late rows
    add(spark, tmp_path / "in", [("s", "b", "two"), ("t", "a", "new text"), ("t", "c", "")], 300)
    assert run(spark, tmp_path)[1:] == [("s", "b", 1, "two"), ("t", "a", 2, "new text"), ("t", "c", 1, "")]
    add(spark, tmp_path / "in", [("t", "a", "late"), ("s", "b", "also late"), ("s", "d", "late, but new")], 200)
    assert run(spark, tmp_path)[1:] == [("s", "b", 1, "two"), ("s", "d", 1, "late, but new"), ("t", "a", 2, "new text"), ("t", "c", 1, "")]
    add(spark, tmp_path / "in", [("t", "a", "other source")], 400)  # back to its first text
    assert ("t", "a", 3, "other source") in run(spark, tmp_path)
    assert [c for c in changes(spark, tmp_path) if c[1] > 1] == [("a", 2, "changed"), ("a", 3, "changed")]


def content(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_what_is_not_seen_again_goes(spark, tmp_path):
    """A path that no batch brings again is told to be gone, by a stream that goes on; one that comes back is new."""
    add(spark, tmp_path / "in", [("s", "a", "one")], 100)
    with pytest.raises(ValueError, match="once=False"):
        run(spark, tmp_path, gone_after_ms=1)
    docs = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).select("*", F.col("_metadata.file_modification_time").alias("modified"))
    query = write_versions(docs, str(tmp_path / "out"), str(tmp_path / "checkpoint"), gone_after_ms=1000, once=False)
    try:
        until(lambda: changes(spark, tmp_path), [("a", 1, "new"), ("a", 2, "gone")])
        add(spark, tmp_path / "in", [("s", "a", "one")], 200)
        until(lambda: changes(spark, tmp_path)[:2], [("a", 1, "new"), ("a", 1, "new")])
    finally:
        query.stop()


def until(look, want):
    for _ in range(120):
        try:
            if look()[: len(want)] == want:
                return
        except Exception:  # noqa: BLE001 - nothing is written yet
            pass
        time.sleep(0.5)
    assert look() == want
