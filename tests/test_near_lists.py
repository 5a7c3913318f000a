"""Rounds over groups of bands against a fold over each list."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.hashing import HASHES
from lodestone.operators import fusion, near_lists


def lists(seed, n, queries=3):
    """Families of signatures that differ in a few slots, chains of them, copies, and strangers."""
    rng, out = np.random.default_rng(seed), []
    for q in range(queries):
        rows = []
        while len(rows) < n:
            base = rng.integers(0, 2**62, HASHES)
            for _ in range(rng.integers(1, 12)):
                own = base.copy()
                slots = rng.choice(HASHES, rng.integers(0, 16), replace=False)
                own[slots] = rng.integers(0, 2**62, len(slots))
                rows.append(own)
                if rng.random() < 0.3:
                    base = own  # drifts away
                if rng.random() < 0.2:
                    rows.append(own)
        order = random.Random(seed + q).sample(range(len(rows)), len(rows))
        out += [(q, rank + 1, f"c{k}", rows[k].tolist()) for rank, k in enumerate(order)]
    return out


SCHEMA = "query_id int, rank int, chunk_id string, signature array<bigint>"


@pytest.mark.parametrize(("threshold", "prefix"), [(0.85, 256), (0.85, 2), (0.95, 1), (0.8, 5), (1.0, 4), (0.3, 8)])
def test_the_same_as_the_fold(spark, tmp_path, threshold, prefix):
    frame = spark.createDataFrame(lists(1, 60), SCHEMA).repartition(3)
    want = fusion.drop_near_duplicates(frame, threshold)
    got = near_lists.keep_first(frame, threshold, str(tmp_path / "k"), prefix=prefix)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bands_miss_no_pair():
    for threshold in (0.05, 0.5, 0.8, 0.85, 0.9, 1.0):
        bands = near_lists.band_bounds(threshold)
        differ = HASHES - int(np.ceil(threshold * HASHES - 1e-9))
        assert bands[0][0] == 0 and bands[-1][1] == HASHES and all(a < b for a, b in bands) and all(x[1] == y[0] for x, y in zip(bands, bands[1:]))
        assert len(bands) > min(differ, HASHES - 1)


def test_a_long_list(spark, tmp_path):
    """20,000 candidates of one query: copies, a family of near copies, and strangers; few rounds."""
    base = F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda s: F.xxhash64(F.col("own"), s))
    rows = spark.range(20_000).select(F.lit(1).alias("query_id"), (F.col("id") + 1).cast("int").alias("rank"), F.col("id").cast("string").alias("chunk_id"), F.when(F.col("id") % 4 == 0, -1).when(F.col("id") % 4 == 1, -2).otherwise(F.col("id")).alias("own"))
    changed = F.transform(base, lambda x, s: F.when((F.col("own") == -2) & (s == F.pmod(F.xxhash64("chunk_id"), F.lit(HASHES))), F.xxhash64("chunk_id")).otherwise(x))
    got = near_lists.keep_first(rows.select("query_id", "rank", "chunk_id", changed.alias("signature")), 0.85, str(tmp_path / "k"))
    assert got.count() == 10_000 + 2 and {r.rank for r in got.filter("rank <= 6").collect()} == {1, 2, 3, 4}
    assert len(list((tmp_path / "k" / "kept").iterdir())) <= 2


def test_no_list(spark, tmp_path):
    assert near_lists.keep_first(spark.createDataFrame([], SCHEMA), 0.85, str(tmp_path / "k")).collect() == []
