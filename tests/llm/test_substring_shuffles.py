"""What substring dedup moves: segments without their words where they take answers, and no segment where hot anchors are few."""

from pyspark.sql import functions as F

from lodestone.llm import substring_dedup as sd


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_segments_are_not_joined(spark, monkeypatch):
    common = " ".join(f"w{k}" for k in range(15))
    docs = spark.createDataFrame([(k, f"{common} x{k} " + " ".join(f"y{k % 7}-{i}" for i in range(14)) + f" {common} z{k}") for k in range(30)], "doc_id long, text string")
    want = sorted(map(tuple, sd.substring_dedup(docs).collect()))
    plans, stored = {}, sd.stored
    monkeypatch.setattr(sd, "stored", lambda df, name: plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = sd.substring_dedup(docs, hot_anchor=2)
        assert sorted(map(tuple, out.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joined = [line for line in plan(out).splitlines() if "Join Inner" in line and "content" in line]
    assert joined and "AS windows" in plan(out)
    assert any("BroadcastHashJoin" in p and "LeftAnti" in p for p in plans["answers"])  # hot anchors are handed out, contents stay
    monkeypatch.setattr(sd, "MOST_HOT", 0)
    assert sorted(map(tuple, sd.substring_dedup(docs, hot_anchor=2).collect())) == want
    assert out.agg(F.sum("n_removed")).first()[0] > 0
