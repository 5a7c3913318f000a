"""Near duplicates of lists of any length: what a fold over each list keeps, found in rounds.

A row of a list stays if no earlier row that stays is at least so similar by MinHash; that is the first maximal independent
set of the graph of similar rows. Two rows that are similar differ in so few slots that of a few bands of slots one at
least is equal, so rows meet in groups of equal bands and no pair is missed. Rows of equal signatures are one row, the
first. In a round

* the first PREFIX rows of each group are compared with each other; a row that is among them in all its groups, and is
  similar to none before it, stays: everything earlier that could drop it is among them;
* what stays is compared with all rows of its groups, and what is similar goes.

Groups are found by keys alone. A row that shares no group stays as it is, and only rows that share some take their
signature to the groups they share.

The first row left of every list is decided in each round, and up to PREFIX rows of each group. No task holds more than a
prefix, and a group of n copies that differ a little is n comparisons, not n * n.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import HASHES, estimated_jaccard

#: Rows of a group that are compared with each other in a round.
PREFIX = 256


def band_bounds(threshold: float) -> list[tuple[int, int]]:
    """Bands of slots, one of which at least is equal for rows that are so similar: one more than slots that may differ."""
    differ = HASHES - math.ceil(threshold * HASHES - 1e-9)
    cuts = np.linspace(0, HASHES, min(differ, HASHES - 1) + 2).round().astype(int).tolist()
    return list(zip(cuts, cuts[1:], strict=False))


def keep_first(ranked: DataFrame, threshold: float, at: str, *, prefix: int = PREFIX) -> DataFrame:
    """ranked (query_id, rank, signature, ...), ranks that don't repeat in a list, to the rows that stay, without their signatures.

    at: a new folder that all executors share; each round writes there what stays, and what is not decided yet.
    """
    spark, bands = ranked.sparkSession, band_bounds(threshold)
    keys = F.array(*(F.xxhash64(F.slice("signature", begin + 1, end - begin)) for begin, end in bands))
    row, group, nth = ["query_id", "rank"], ["query_id", "band", "key"], 0

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{at}/{name}/round={nth}")
        return spark.read.parquet(f"{at}/{name}/round={nth}")

    left = written(ranked.groupBy("query_id", "signature").agg(F.min("rank").alias("rank")), "left")
    while not left.isEmpty():
        each = left.select(*row, F.posexplode(keys).alias("band", "key"))
        several = each.groupBy(*group).agg(F.count("*").alias("n")).filter("n > 1").select(group)
        shared = written(each.join(several, group), "shared")
        signed = left.join(shared.select(row).distinct(), row, "left_semi").select(*row, "signature")
        place = F.row_number().over(Window.partitionBy(*group).orderBy("rank"))
        near = shared.withColumn("place", place).filter(F.col("place") <= prefix)
        first = near.join(signed, row)
        before = first.select(*group, F.col("place").alias("earlier"), F.col("signature").alias("other"))
        blocked = first.join(before, group).filter((F.col("earlier") < F.col("place")) & (estimated_jaccard(F.col("signature"), F.col("other")) >= threshold)).select(row)
        beyond = shared.select(*row, "band").join(near.select(*row, "band"), [*row, "band"], "left_anti").select(row)
        stay = written(left.join(blocked.unionByName(beyond).distinct(), row, "left_anti").select(*row, "signature"), "kept")
        kept = shared.join(stay, row).select(*group, F.col("rank").alias("by"), F.col("signature").alias("other"))
        gone = shared.join(signed, row).join(kept, group).filter((F.col("by") < F.col("rank")) & (estimated_jaccard(F.col("signature"), F.col("other")) >= threshold))
        decided = stay.select(row).unionByName(gone.select(row)).distinct()
        nth += 1
        left = written(left.join(decided, row, "left_anti"), "left")
    if not nth:
        return ranked.limit(0).drop("signature")
    return ranked.drop("signature").join(spark.read.parquet(f"{at}/kept").select("query_id", "rank"), ["query_id", "rank"]).select([c for c in ranked.columns if c != "signature"])
