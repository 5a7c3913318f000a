"""The corpus pipeline: five stages, each one operator of lodestone.llm over all documents that its predecessor kept.

quality: documents that the classifier rejects (low quality or toxic) go. exact: of equal texts the row with the smallest id
stays. near: of documents linked by a Jaccard similarity of 0.8 on five-word shingles one stays. mix: documents are
repeated or left out so that sources come to their target weights. encode: token ids, as op8_bpe reports them.

Defined results: rows with a null id pass exact and near dedup as one id, null, and so stay unless an equal text has
another id; of rows that repeat an id and text one stays; an empty table gives an empty result; documents may have
further columns, which reach the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, exact_dedup, mixing, ngram_join, quality
from lodestone.llm.common import SPACE_PATTERN, read_table, stored


def _unused(docs: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = _unused(docs, "score")
    scored = quality.score_documents(docs, read_table(spark, sf_dir, "labels"), name=name)
    return scored.filter(F.col(f"{name}.kept")).select(docs.columns)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sha, kept_id, kept_sha = (_unused(docs, c) for c in ("sha", "kept_id", "kept_sha"))
    kept = exact_dedup.exact_dedup(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha)).distinct()
    rows = docs.withColumn(sha, F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE_PATTERN, " ").cast("binary"), 256))
    joined = rows.join(kept, (F.col(sha) == F.col(kept_sha)) & F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")
    return joined.dropDuplicates([sha, "doc_id"]).select(docs.columns)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept_id = _unused(docs, "kept_id")
    kept = ngram_join.near_documents(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias(kept_id)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi").select(docs.columns)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(docs.select("doc_id", "text"))


STAGES = [("quality", stage_quality), ("exact", stage_exact), ("near", stage_near), ("mix", stage_mix), ("encode", stage_encode)]

#: A trained classifier and Bernoulli draws after it have no SQL: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
