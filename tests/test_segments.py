"""The segmented index against scoring every posting, over random corpora and histories."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import segments
from lodestone.operators.bm25 import bm25_search, build_index
from lodestone.schemas import Bm25Config

WORDS = [f"w{k}" for k in range(60)]


def corpus(rng, ids):
    return {i: " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(60)], k=rng.choice([0, 1, 5, 30, 80]))) for i in ids}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "chunk_id string, text string").repartition(3)


def asked(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(WORDS, k=4))) for k in range(6)] + [(90, "w0 w0 w59"), (91, "absent"), (92, ""), (93, "w0")]
    return spark.createDataFrame(rows, "query_id long, text string")


def found(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("config", [Bm25Config(), Bm25Config(k1=0.4, b=1.0)])
def test_blocks_give_what_all_postings_give(spark, tmp_path, config):
    texts = corpus(random.Random(1), [f"c{k:04d}" for k in range(400)])
    texts |= {f"copy{k}": "w0 w1 w59" for k in range(30)}  # ties
    chunks = frame(spark, texts)
    index = segments.add_segment(segments.SegmentedIndex(spark), str(tmp_path), chunks, block_bits=2)
    for k in (1, 7, 1000):
        want = found(bm25_search(build_index(chunks), asked(spark), k, config, digits=6))
        assert found(segments.block_search(index, asked(spark), k, config, digits=6, first_ranges=3)) == want
    assert found(segments.block_search(index, asked(spark), 7, config)) == found(bm25_search(build_index(chunks), asked(spark), 7, config))
    opened = segments.SegmentedIndex.open(spark, index.paths())
    assert opened == index and opened.statistics().first()["n"] == 430


def test_few_postings_are_read(spark, tmp_path):
    """A term that stands in every chunk, in many blocks and files; a search for it and a rare one reads the rare one's ranges."""
    texts = {f"c{k:05d}": "common " * (1 + k % 3) + "filler " * (k % 7) + ("rare" if k in (77, 2900) else "") for k in range(4000)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the blocks were large
    try:
        index = segments.add_segment(segments.SegmentedIndex(spark), str(tmp_path), spark.createDataFrame(list(texts.items()), "chunk_id string, text string").coalesce(2), block_bits=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks = index.blocks().filter("term = 'common'")
    assert blocks.count() == 250 and blocks.agg(F.max("n")).first()[0] == 16
    assert blocks.select(F.input_file_name()).distinct().count() > 1
    one = spark.createDataFrame([(1, "common rare")], "query_id long, text string")
    first, second = segments.passes(index, one, 2)
    read = sum(r[0] or 0 for r in (first.agg(F.sum("n")).first(), second.agg(F.sum("n")).first()))
    assert read < 0.05 * 4000
    assert {r[2] for r in found(segments.block_search(index, one, 2))} == {"c02900", "c00077"}


def test_an_index_that_follows_changes(spark, tmp_path):
    """Scores after any history are those of an index built anew; only what changed is written."""
    rng = random.Random(5)
    now = corpus(rng, [f"c{k:03d}" for k in range(200)])
    index = segments.refreshed(segments.SegmentedIndex(spark), frame(spark, now), str(tmp_path), block_bits=3)
    sizes = []
    for turn in range(5):
        ids = rng.sample(sorted(now), 12)
        for i in ids[:4]:
            del now[i]
        now |= corpus(rng, ids[4:8]) | corpus(rng, [f"n{turn}{k}" for k in range(3)]) | (corpus(rng, ids[:1]) if turn % 2 else {})
        before = index
        index = segments.refreshed(index, frame(spark, now), str(tmp_path), block_bits=3)
        sizes.append([s.postings for s in index.segments])
        assert len(index.segments) == 1 or index.segments[0] == before.segments[0]
        chunks = frame(spark, now)
        assert found(segments.block_search(index, asked(spark), 10, digits=6)) == found(bm25_search(build_index(chunks), asked(spark), 10, digits=6))
        assert {r.chunk_id for r in index.chunks().collect()} == set(now)
    assert any(len(s) > 1 for s in sizes) and max(map(len, sizes)) < 5
    assert segments.refreshed(index, frame(spark, now), str(tmp_path)) == index
    whole = segments.merged(index, str(tmp_path), len(index.segments), block_bits=3)
    assert len(whole.segments) == 1 and whole.removed().count() == 0
    assert found(segments.block_search(whole, asked(spark), 10, digits=6)) == found(bm25_search(build_index(frame(spark, now)), asked(spark), 10, digits=6))


def test_merges_within_a_history(spark, tmp_path):
    """Segments merged in the middle of a history, with removals across and within them, and a merged segment that is then removed from."""
    rng = random.Random(9)
    now = corpus(rng, [f"c{k:03d}" for k in range(60)])
    index = segments.add_segment(segments.SegmentedIndex(spark), str(tmp_path), frame(spark, now), block_bits=2)
    for turn in range(4):
        ids = rng.sample(sorted(now), 8)
        change = corpus(rng, ids[:5]) | corpus(rng, [f"n{turn}"])
        now = {i: t for i, t in now.items() if i not in ids} | change
        index = segments.add_segment(index, str(tmp_path), frame(spark, change), spark.createDataFrame([(i,) for i in [*ids, "never there"]], "chunk_id string"), block_bits=2)
        if turn == 2:
            index = segments.merged(index, str(tmp_path), 2, block_bits=2)
    assert len(index.segments) == 4
    want = found(bm25_search(build_index(frame(spark, now)), asked(spark), 10, digits=6))
    assert found(segments.block_search(index, asked(spark), 10, digits=6)) == want
    assert found(segments.block_search(segments.merged(index, str(tmp_path), 3, block_bits=2), asked(spark), 10, digits=6)) == want


def test_an_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id string, text string")
    index = segments.add_segment(segments.SegmentedIndex(spark), str(tmp_path), none)
    assert found(segments.block_search(index, asked(spark), 3)) == []
    texts = {"a": "w0 w1", "b": None}
    index = segments.refreshed(index, frame(spark, texts), str(tmp_path))
    assert [r[2] for r in found(segments.block_search(index, asked(spark).filter("query_id = 93"), 3))] == ["a"]
    index = segments.refreshed(index, none, str(tmp_path))
    assert index.statistics().first()["n"] == 0 and found(segments.block_search(index, asked(spark), 3)) == []


def test_postings_are_grouped_where_they_are_made(spark, tmp_path):
    """All blocks of a range lie in one file: texts were dealt by range, and no posting was shuffled."""
    texts = corpus(random.Random(3), [f"c{k:04d}" for k in range(300)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = segments.add_segment(segments.SegmentedIndex(spark), str(tmp_path), frame(spark, texts), block_bits=3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = index.blocks().select("range", F.input_file_name().alias("f"))
    assert files.groupBy("range").agg(F.countDistinct("f").alias("n")).agg(F.max("n")).first()[0] == 1
    assert files.select("f").distinct().count() > 1
