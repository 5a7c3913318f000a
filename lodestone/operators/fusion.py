"""Fusion, hydration, near-duplicate removal and packing of ranked lists. All lists are batches: one per query_id."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import HASHES, minhash
from ..functions.text import estimate_tokens, estimate_tokens_by_words, tokenize


def rrf(ranked: DataFrame, k: int = 60, *, carry: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """Ranked lists (query_id, chunk_id, rank), one below the other, to (query_id, chunk_id, rrf, rank): the sum of 1 / (k + rank), ties by chunk_id.

    The columns in carry stay, with their largest value over the lists: a score of one arm is null in the others.
    """
    total = F.sum(1 / (F.lit(float(k)) + F.col("rank")))
    fused = ranked.groupBy("query_id", "chunk_id").agg((total if digits is None else F.round(total, digits)).alias("rrf"), *[F.max(c).alias(c) for c in carry])
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "chunk_id")))


def hydrate(ranked: DataFrame, chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Ranked ids with their chunks' columns, and their documents' path; late, so that only winners' texts move."""
    found = ranked.join(chunks, "chunk_id")
    return found if documents is None else found.join(documents.select("document_id", "path_or_url"), "document_id")


def _greedy(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    kept: list[np.ndarray] = []
    flags = []
    for own in group.sort_values("rank")["signature"]:
        new = not any((own == other).sum() / HASHES >= threshold for other in kept)
        flags.append(new)
        if new:
            kept.append(own)
    return group.sort_values("rank")[flags].drop(columns="signature")


def signed(ids: DataFrame, chunks: DataFrame, *more: Column, text: str = "text") -> DataFrame:
    """(chunk_id, signature) of the chunks with these distinct ids, and further columns of theirs.

    Signing is the dear part: it is dealt to all cores, however few bytes the ids and their texts are.
    """
    spark = chunks.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own = chunks.join(ids.select("chunk_id"), "chunk_id", "left_semi").repartition(tasks, "chunk_id")
    return own.select("chunk_id", minhash(tokenize(F.col(text))).alias("signature"), *more)


def drop_near_duplicates(ranked: DataFrame, threshold: float = 0.85, text: str = "text") -> DataFrame:
    """Of each query's list, in rank order, a row goes if a kept one is at least so similar by MinHash of word trigrams.

    ranked has signatures, as signed() gives them, or texts to sign. A list holds the candidates of one query, bounded by what
    its arms return. Two texts without tokens are alike.
    """
    known = ranked if "signature" in ranked.columns else ranked.withColumn("signature", minhash(tokenize(F.col(text))))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _greedy(group, threshold)

    return known.groupBy("query_id").applyInPandas(run, known.drop("signature").schema)


def pack_skipping(ranked: DataFrame, budget: int, cost: Column | None = None) -> DataFrame:
    """In rank order, rows that still fit; rows that don't are passed over, rows of no cost dropped. Adds `cost`."""
    price = estimate_tokens_by_words(F.col("text")) if cost is None else cost
    rows = ranked.withColumn("cost", price.cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"))

    def step(acc: Column, item: Column) -> Column:
        fits = (item["cost"] > 0) & (acc["used"] + item["cost"] <= budget)
        more = F.struct((acc["used"] + item["cost"]).alias("used"), F.array_append(acc["taken"], item["rank"]).alias("taken"))
        return F.when(fits, more).otherwise(acc)

    # a list is one query's candidates, so it fits a row; a join back would compute all that is upstream twice
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cost"))).alias("costs"), F.collect_list(F.struct(*rows.columns)).alias("rows"))
    taken = lists.select("rows", F.aggregate("costs", start, step)["taken"].alias("taken"))
    return taken.select(F.explode(F.filter("rows", lambda r: F.array_contains(F.col("taken"), r["rank"]))).alias("r")).select("r.*")


def pack_stopping(ranked: DataFrame, budget: int = 6000, cost: Column | None = None) -> DataFrame:
    """In rank order up to the first row that doesn't fit, the first row in any case. Adds `cost`, `used`."""
    price = estimate_tokens(F.col("text")) if cost is None else cost
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = ranked.withColumn("cost", price.cast("long")).withColumn("used", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("nth", F.row_number().over(order)).filter((F.col("nth") == 1) | (F.col("used") <= budget)).drop("nth")


def rejected(queries: DataFrame, ranked: DataFrame, threshold: float = 0.15, score: str = "score") -> DataFrame:
    """(query_id, rejected): no hit, or the best below the threshold."""
    best = ranked.groupBy("query_id").agg(F.min_by(score, "rank").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce(F.col("best") < threshold, F.lit(True)).alias("rejected"))
