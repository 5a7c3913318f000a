"""The k best of each query are chosen where the chunks are, and the evidence job moves a text once."""

import random

from pyspark.sql import functions as F

from jobs import evidence
from jobs.common import settings
from lodestone.operators import bm25


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_are_chosen_before_the_shuffle(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    rows = [(f"c{k:03}", " ".join(rng.choices(words, k=rng.randint(0, 30)))) for k in range(300)] + [(f"d{k:03}", "salt marsh w1 w2") for k in range(40)] + [("e", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").repartition(5)
    asked = spark.createDataFrame([(k, " ".join(rng.choices(words, k=6)) + " salt" * (k % 3)) for k in range(12)] + [(99, "absent"), (100, "")], "query_id long, text string")
    monkeypatch.setattr(bm25, "SLICE", 64)  # chunks by few, and held ones gone through often
    for index in (bm25.build_index(chunks), bm25.build_index(chunks, str(tmp_path / "i"))):
        for k, digits in ((7, 6), (3, 1), (50, None)):
            found = bm25.bm25_search(index, asked, k, digits=digits)
            want = bm25.top_k(bm25.bm25_scores(index, asked), k, digits=digits)
            if digits is None:
                found, want = (df.withColumn("score", F.round("score", 9)).drop("rank") for df in (found, want))
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select(found.columns).collect()))
    assert "hashpartitioning(query_id" in plan(found) and "HashAggregate" not in plan(found)  # no score of a chunk that is not among its task's best is shuffled


def test_evidence_moves_texts_once(spark):
    docs = spark.createDataFrame([(str(k), f"Text {k}. More of it.", "a") for k in range(20)], "id string, text string, part string")
    assert plan(evidence.cut(docs, settings("evidence"))).count("Exchange") == 1
    again = docs.unionByName(spark.createDataFrame([("3", "Text 3. More of it.", "b"), ("4", "Other.", "b"), ("4", None, "c"), (None, "No id.", "a")], docs.schema))
    got = {r.id: (r.text, r.part) for r in evidence.cut(again, settings("evidence")).collect()}
    want = {str(k): (f"Text {k}. More of it.", "a") for k in range(20)} | {"3": ("Text 3. More of it.", "b")}
    texts = ("Text 4. More of it.", "a"), ("Other.", "b"), ("", "c")
    best = max(texts, key=lambda t: spark.range(1).select(F.sha2(F.lit(t[0]), 256)).first()[0])
    assert got == {k: v for k, v in (want | {"4": best}).items() if v[0]}
