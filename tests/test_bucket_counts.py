"""Hashed words of a document."""

from pyspark.sql import functions as F

from lodestone.functions import hashing, text


def test_bucket_counts(spark):
    """Counted in the row: words are not shuffled."""
    rows = spark.createDataFrame([(1, "a b A"), (2, ""), (3, None), (1, "b")], "doc_id long, text string").coalesce(1)
    each = rows.select("doc_id", F.explode(hashing.bucket_counts(text.words(F.lower("text")), 768)).alias("b")).select("doc_id", "b.*")
    at = {w: int(hashing.fnv1a_all([w.encode()])[0] % 768) for w in "ab"}
    assert sorted(map(tuple, each.collect())) == sorted([(1, at["a"], 2), (1, at["b"], 1), (1, at["b"], 1)])
    assert "Exchange" not in each._jdf.queryExecution().executedPlan().toString()
