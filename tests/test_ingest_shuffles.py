"""What an ingest costs: texts are shuffled once, and segments are found by arrays, not by a search for each."""

import random
import re
import sys

import numpy as np
import regex

from lodestone.functions.hashing import fnv1a_all
from lodestone.operators import chunking, embedding
from lodestone.plans import ingest as plan
from lodestone.plans.store import Store
from lodestone.schemas import ChunkConfig
from lodestone.sources.readers import read_texts

SIGNS = ["a", "Bc", "é", "日本", "😀", ".", "!", "?", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x1f", " ", "　", " ", "\x85", "```\n", "# H\n", "\r\n", "\x0b", "、"]


def test_texts_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Paths that repeat, with the same text or another, and a null path give one document each."""
    rows = [("a", "One. Two."), ("a", "One. Two."), ("b", "x y"), ("b", "z w"), (None, "no path"), ("c", None), ("d", " ")]
    seen = []
    monkeypatch.setattr(plan, "chunk_documents", lambda docs, config: (seen.append(docs), chunking.chunk_documents(docs, config))[1])
    store = Store(spark, f"file://{tmp_path}")
    docs = read_texts(spark.createDataFrame(rows, "path string, text string").repartition(3))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        summary = plan.ingest(store, "s", docs, embedding.HashEmbedder(8), now_ms=0)
        (texts,) = seen
        text = spark._jvm.PythonSQLUtils.explainString(texts._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [x for x in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)\nArguments: hash", text) if re.search("text#|first#", x)]  # a partial dropDuplicates calls it first
    assert len(moved) == 1
    assert (summary.documents_ingested, summary.documents_skipped, summary.documents_failed) == (3, 1, 1)
    docs_hashes = {r["path"]: r["h"] for r in docs.groupBy("path").agg({"content_hash": "min"}).toDF("path", "h").collect()}
    got = store.read("document").collect()
    assert {r["path_or_url"]: r["content_hash"] for r in got} == {p: docs_hashes[p] for p in ("a", "b", None)} and len(got) == 3
    assert store.read("chunk").count() == 3


def chunks_by_definition(text, kind, most, overlap):
    left = lambda t: regex.sub(r"\A\s+", "", t)
    blocks = list(chunking.markdown_blocks(text)) if kind == "markdown" else [(0, len(text), None, kind == "code")]
    out = []
    for start, end, path, code in blocks:
        part = text[start:end]
        cuts = [m.end() for m in regex.finditer(r"\n" if code else r"[.!?](?=\s|\Z)|\n(?=\n)", part)]
        bounds = []
        for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
            lead = 0 if code else len(part[a:b]) - len(left(part[a:b]))
            if lead < b - a:
                bounds.append((start + a + lead, start + b))
        dense = [len(regex.sub(r"\s+", "", text[a:b])) for a, b in bounds]
        tokens = [max(1, n // 4) if n else 0 for n in dense]
        for i, j in chunking.windows(tokens, most, overlap):
            a, b = bounds[i][0], bounds[j][1]
            if body := left(left(text[a:b])[::-1])[::-1]:
                out.append((len(out), body, sum(tokens[i : j + 1]), path, len(text[:a].encode()), len(text[:b].encode())))
    return out


def test_chunks_by_definition():
    rng = random.Random(4)
    for k in range(3000):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40)))
        kind, (most, overlap) = ("plain", "markdown", "code")[k % 3], rng.choice([(1, 0), (5, 2), (500, 50)])
        assert [tuple(c.values()) for c in chunking.chunk_text(text, kind, ChunkConfig(max_tokens=most, overlap_tokens=overlap))] == chunks_by_definition(text, kind, most, overlap)


def test_no_call_for_each_segment():
    text, calls = "A sentence of some seventy letters, so that twenty make a window here. " * 4000, [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        chunking.chunk_text(text, "plain", ChunkConfig())
    finally:
        sys.setprofile(None)
    assert calls[0] < 4 * 4000  # it was 12.7 a segment, now 0.3


def test_bucket_counts_by_definition():
    rng = random.Random(5)
    texts = [None, "", "a\x1cb A\x1cB"] + ["".join(rng.choice(SIGNS) for _ in range(30)) for _ in range(300)]
    want = np.zeros((len(texts), 16))
    for row, t in enumerate(texts):
        for w in regex.split(r"\s+", (t or "").lower()):
            if w:
                want[row, int(fnv1a_all([w.encode()])[0] % np.uint64(16))] += 1
    assert (embedding.bucket_counts(texts, 16) == want).all()
