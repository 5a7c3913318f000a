"""A stream's figures are heard before it ends."""

import os
import threading

from lodestone.operators.embedding import HashEmbedder
from lodestone.plans.store import Store
from lodestone.streaming import reingest

SCHEMA = "path string, text string"


def test_each_batch_is_heard_while_the_stream_runs(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"p{k}", f"Text {k}."), (f"q{k}", None if k == 1 else "Words."), ("same", "Never changes.")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for p in (tmp_path / "in").glob("part-*.parquet"):
            if p.stat().st_mtime > 10_000:
                os.utime(p, (k, k))
    heard, second, query = [], threading.Event(), None
    alive = []

    def tell(figures):
        heard.append(figures)
        if "batch" in figures and query is not None:
            alive.append(query.isActive)
        if len(heard) == 2:
            second.set()

    store = Store(spark, f"file://{tmp_path}/s")
    query = reingest.ingest_stream(reingest.stream_texts(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=1), store, "s", HashEmbedder(16), str(tmp_path / "c"), on_progress=tell)
    other = spark.readStream.format("rate").load().writeStream.format("noop").trigger(availableNow=True).start()  # not ours
    other.awaitTermination()
    query.awaitTermination()
    assert second.wait(30)
    for _ in range(100):
        if heard[-1].get("ended"):
            break
        threading.Event().wait(0.1)
    figures, times = [f for f in heard if "chunks_created" in f], [f for f in heard if "seconds" in f]
    assert [(f["batch"], f["documents_ingested"], f["documents_skipped"], f["documents_failed"]) for f in figures] == [(0, 3, 0, 0), (1, 1, 1, 1), (2, 2, 1, 0)]
    assert [f["batch"] for f in times] == [0, 1, 2] and all(f["seconds"] > 0 for f in times) and heard[-1] == {"ended": True, "error": None}
    assert any(alive[:2])
    assert store.read("document").count() == 6
