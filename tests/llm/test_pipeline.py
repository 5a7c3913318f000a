import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import bpe, mixing, quality

from .test_text_operators import brute_near

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.score_documents(docs, labels).filter("score.kept").select(docs.columns).orderBy("doc_id").collect()
    seen, exact = set(), []
    for r in kept:
        if (key := " ".join(r.text.split())) not in seen:
            seen.add(key)
            exact.append(r)
    stays = {i for i, _, _, keep in brute_near([(r.doc_id, r.text) for r in exact]) if keep}
    near = [r for r in exact if r.doc_id in stays]
    assert 0 < len(near) < len(exact) < len(kept) < docs.count()
    plan = mixing.mixing_plan(spark.createDataFrame(near, docs.schema))
    whole = tiktoken.Encoding("w", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
    ids = {r.doc_id: np.array(whole.encode_ordinary(r.text), "<u4") for r in near}
    want = Counter({(i, len(ids[i]), hashlib.sha256(ids[i].tobytes()).hexdigest()): n for i, n in ((r.row.doc_id, r.copies) for r in plan.collect()) if n})
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_clean_documents_stay(spark):
    """Judged on labels that no one learned from: clean documents stay, bad ones go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score_documents(docs.repartition(4), labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1").withColumnRenamed("quality", "good"), "doc_id").cache()
    kept = lambda which: out.filter(which).agg(F.avg(F.col("score.kept").cast("int"))).first()[0]
    assert kept("good = 1 and toxic = 0") > 0.98 and kept("good = 0") < 0.05 and kept("toxic = 1") < 0.5


def test_stages_take_hard_rows(spark, docs, rows, tmp_path):
    """Nulls, ties, repeated rows and clashing columns pass all stages; so does an empty table."""
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, docs.limit(0)):
        at = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, at, str(tmp_path)).write.parquet(out := f"{tmp_path}/{name}-{start is docs}")
            at = spark.read.parquet(out)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert at.columns == docs.columns
        if start is not docs:
            assert at.count() == 0
    near = spark.read.parquet(f"{tmp_path}/near-True")
    assert near.filter("doc_id between 100 and 299").count() == 1 and near.filter("doc_id = 5").count() == 1
