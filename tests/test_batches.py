"""What Python makes of an Arrow batch is bounded by bytes, however many rows and however long texts the batch has."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import batches
from lodestone.functions.vectors import as_lists
from lodestone.operators import embedding, vector_search


def peak(run):
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_slices():
    assert list(batches.slices(pa.array(["xxx"] * 7), 7)) == [(0, 2), (2, 4), (4, 6), (6, 7)]
    assert list(batches.slices(pa.array(["x" * 30, None, "x"]), 7)) == [(0, 1), (1, 3)]
    lists = pa.array([["a", "bc"], None, [], ["ü"]])
    assert batches.text_bytes(lists).tolist() == [3, 0, 0, 2] and batches.text_bytes(lists.slice(2)).tolist() == [0, 2]
    assert list(batches.slices(pa.array([], pa.string()))) == []


class Watching(embedding.HashEmbedder):
    def embed(self, texts):
        if sum(len(t or "") for t in texts) > batches.SLICE_BYTES:
            raise ValueError("too much text at once")
        return super().embed(texts)


def test_embedding_by_bytes(spark):
    rows = spark.range(40).coalesce(1).select(F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")), 30_000).alias("text"))
    got = rows.select(Watching().vectors(F.col("text")).alias("v")).select(F.size(F.filter("v", lambda x: x != 0)).alias("n"))
    assert [r.n for r in got.collect()] == [1] * 40


@pytest.mark.parametrize("width", [768, 16])
def test_products_by_bytes(width):
    rng = np.random.default_rng(1)
    rows, asked = rng.normal(size=(4096, width)), rng.normal(size=(600, width))

    class Shared:
        value = asked, np.full(600, width)

    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), as_lists(rows)], names=["chunk_id", "vector"])
    assert peak(lambda: list(vector_search._best([batch], Shared, 5, None))) < 80
    got = list(vector_search._best([batch], Shared, 5, None))
    assert sum(b.num_rows for b in got) == 3000
    unit = rows.astype(np.float32).astype(float)
    best = np.sort(-(asked[599] @ (unit / np.linalg.norm(unit, axis=1, keepdims=True)).T))[:5]
    assert np.allclose(np.sort(-got[-1].column("score").to_numpy()[-5:]), best)
