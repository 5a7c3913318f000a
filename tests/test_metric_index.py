"""The metric index against comparing all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import metric_index
from lodestone.operators.vector_search import cosine_search


def clusters(rng, n, dim, around=12):
    centres = rng.normal(size=(around, dim))
    return centres[rng.integers(around, size=n)] + 0.25 * rng.normal(size=(n, dim))


def frame(spark, rows, key):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v]) for k, v in rows], f"{key} string, vector array<float>").repartition(3)


def found(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    near = clusters(rng, 900, 12)
    out = [(f"v{k:04d}", v) for k, v in enumerate(near)]
    out += [(f"copy{k}", near[0]) for k in range(40)] + [(f"opposite{k}", -near[0]) for k in range(3)]
    out += [("zero", np.zeros(12)), ("none", None), ("empty", []), ("short", near[0][:5]), ("nan", np.full(12, np.nan)), ("again", near[5]), ("again2", near[5])]
    return out


def asked(rows):
    rng = np.random.default_rng(4)
    own = [(f"q{k}", v) for k, (_, v) in enumerate(rows[:25])]
    return own + [("far", rng.normal(size=12)), ("opposite", -rows[0][1]), ("zero", np.zeros(12)), ("scaled", 100 * rows[7][1])]


@pytest.mark.parametrize("k", [1, 10, 2000])
def test_the_same_as_all_pairs(spark, rows, tmp_path, k):
    vectors, queries = frame(spark, rows, "chunk_id"), frame(spark, asked(rows), "query_id")
    index = metric_index.build_metric_index(vectors, str(tmp_path / "i"), pivots=20, block_bits=4)
    plain = vectors.filter("chunk_id <> 'nan'").unionByName(spark.createDataFrame([("nan", [0.0] * 12)], "chunk_id string, vector array<float>"))
    assert found(metric_index.metric_search(index, queries, k, digits=5)) == found(cosine_search(plain, queries, k, digits=5))


def test_most_rings_are_passed_over(spark, rows, tmp_path):
    index = metric_index.build_metric_index(frame(spark, rows, "chunk_id"), str(tmp_path / "i"), pivots=30, block_bits=4)
    queries = frame(spark, [q for q in asked(rows) if q[0].startswith("q")], "query_id")
    first, _, then = metric_index.visited(index, queries, 5)
    visits, every = first.count() + then.count(), index.table("rings").count() * queries.count()
    assert index.table("rings").agg(F.max("n")).first()[0] <= 16
    assert visits < 0.35 * every


def test_many_queries_of_one_ring(spark, rows, tmp_path, monkeypatch):
    """A ring that all queries visit is copied for blocks of them."""
    monkeypatch.setattr(metric_index, "QUERY_BLOCK", 7)
    rng = random.Random(1)
    vectors = frame(spark, rows, "chunk_id")
    index = metric_index.build_metric_index(vectors, str(tmp_path / "i"), pivots=5, block_bits=6)
    queries = frame(spark, [(f"q{k}", rows[0][1] + rng.random() / 50) for k in range(150)], "query_id")
    plain = vectors.filter("chunk_id <> 'nan'").unionByName(spark.createDataFrame([("nan", [0.0] * 12)], "chunk_id string, vector array<float>"))
    assert found(metric_index.metric_search(index, queries, 5, digits=5)) == found(cosine_search(plain, queries, 5, digits=5))


def test_nothing_and_other_dimensions(spark, rows, tmp_path):
    none = metric_index.build_metric_index(frame(spark, [], "chunk_id"), str(tmp_path / "n"))
    assert found(metric_index.metric_search(none, frame(spark, asked(rows), "query_id"), 3)) == []
    odd = metric_index.build_metric_index(frame(spark, [("b", []), ("a", None)], "chunk_id"), str(tmp_path / "o"))
    assert found(metric_index.metric_search(odd, frame(spark, [("q", [1.0, 2.0])], "query_id"), 1)) == [("q", 1, "a", 0.0)]
    index = metric_index.build_metric_index(frame(spark, rows, "chunk_id"), str(tmp_path / "i"))
    assert found(metric_index.metric_search(index, frame(spark, [], "query_id"), 3)) == []
    with pytest.raises(Exception, match="a query has 2 dimensions, the index has 12"):
        metric_index.metric_search(index, frame(spark, [("q", [1.0, 2.0])], "query_id"), 3).collect()
