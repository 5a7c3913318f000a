"""What the rounds of near_lists move: keys of all rows, and signatures of those that share a group."""

import numpy as np

from lodestone.operators import near_lists


def test_strangers_take_no_signature_to_groups(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(0, k + 1, rng.integers(0, 2**62, near_lists.HASHES).tolist()) for k in range(40)]
    near = [*rows[7][2]]
    near[0] = 1
    frame = spark.createDataFrame([*rows, (0, 41, near)], "query_id int, rank int, signature array<bigint>")
    got = near_lists.keep_first(frame, 0.85, str(tmp_path / "k"))
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 41))
    shared = spark.read.parquet(str(tmp_path / "k" / "shared"))
    assert "signature" not in shared.columns and {r["rank"] for r in shared.collect()} == {8, 41}
