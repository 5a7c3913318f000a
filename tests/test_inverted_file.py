"""The inverted file against comparing all pairs."""

import numpy as np
import pytest

from lodestone.operators import inverted_file
from lodestone.operators.vector_search import cosine_search
from lodestone.plans.vectors import InvertedFileVectors

DIM = 30


def frame(spark, rows, documents=7):
    return spark.createDataFrame([(f"v{k:05d}", f"d{k % documents}", None if v is None else [float(x) for x in v]) for k, v in rows], "chunk_id string, document_id string, vector array<float>").repartition(3)


def asked(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "query_id long, vector array<float>")


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.chunk_id] = round(r.score, 5)
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    return rng.normal(size=(40, DIM))[rng.integers(40, size=3000)] + 0.6 * rng.normal(size=(3000, DIM))


def test_recall(spark, tmp_path, vectors):
    """Over queries that are near vectors and queries that are near none."""
    rng = np.random.default_rng(9)
    store = InvertedFileVectors(spark, str(tmp_path / "i"))
    store.upsert(frame(spark, enumerate(vectors)))
    queries = asked(spark, list(enumerate([*(vectors[:40] + 0.2 * rng.normal(size=(40, DIM))), *rng.normal(size=(20, DIM))])))
    want, got = found(store.search(queries, 10, exact=True)), found(store.search(queries, 10))
    recall = np.mean([len(want[q].keys() & got[q].keys()) / 10 for q in want])
    assert recall >= 0.9
    assert all(abs(got[q][c] - want[q][c]) < 1e-4 for q in want for c in want[q].keys() & got[q].keys())
    assert want == found(cosine_search(frame(spark, enumerate(vectors)).select("chunk_id", "vector"), queries, 10))


def test_upserts_and_deletions(spark, tmp_path, vectors, monkeypatch):
    monkeypatch.setattr(inverted_file, "BLOCK", 50)
    monkeypatch.setattr(inverted_file, "QUERY_BLOCK", 3)
    now = {k: v for k, v in enumerate(vectors[:600])}
    store = InvertedFileVectors(spark, str(tmp_path / "i"), probes=1000, refine=60)
    store.upsert(frame(spark, now.items()))
    change = {k: -vectors[k] for k in range(0, 600, 5)} | {k: vectors[k] for k in range(600, 640)}
    store.upsert(frame(spark, change.items()))
    now |= change
    store.delete_document(spark.createDataFrame([("d3",), ("none",)], "document_id string"))
    now = {k: v for k, v in now.items() if k % 7 != 3}
    back = {k: vectors[k] for k in range(3, 30, 7)}
    store.upsert(frame(spark, back.items()))
    now |= back
    queries = asked(spark, list(enumerate(vectors[:25])))
    want = found(cosine_search(frame(spark, now.items()).select("chunk_id", "vector"), queries, 8, digits=5))
    assert found(store.search(queries, 8, digits=5, exact=True)) == want
    assert found(store.search(queries, 8, digits=5)) == want
    assert store.live().count() == len(now)


def test_vectors_without_a_cosine(spark, tmp_path, vectors):
    odd = [(9000, None), (9001, []), (9002, np.zeros(DIM)), (9003, vectors[0][:5]), (9004, np.full(DIM, np.nan))]
    store = InvertedFileVectors(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError, match="no vector to fit"):
        store.upsert(frame(spark, [o for o in odd if o[0] != 9003]))
    store.upsert(frame(spark, [*enumerate(vectors[:100]), *odd]))
    queries = asked(spark, [(1, vectors[0]), (2, np.zeros(DIM)), (3, vectors[0][:5])])
    got = found(store.search(queries, 5))
    assert got.keys() == {1} and got[1]["v00000"] == 1.0 and len(got[1]) == 5
    assert store.live().count() == 105


def test_codes_are_near(vectors):
    book = inverted_file.fit(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    rows = vectors[:200] / np.linalg.norm(vectors[:200], axis=1, keepdims=True)
    own, codes = book.encode(rows)
    for k in np.unique(own):
        mine = own == k
        assert np.abs(book.estimates(rows[:20], k, codes[mine]) - rows[:20] @ rows[mine].T).mean() < 0.05


def test_certain(spark, tmp_path):
    """Among vectors that no code tells apart, with one candidate re-ranked for each hit: what comparing all gives, with ties and few vectors too."""
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(1500, DIM))
    store = InvertedFileVectors(spark, str(tmp_path / "i"), refine=1)
    store.upsert(frame(spark, enumerate([*rows, *rows[:5], *rows[:5]])))
    queries = asked(spark, list(enumerate([*rng.normal(size=(10, DIM)), *rows[:3], np.zeros(DIM)])))
    for k, digits in ((10, 6), (2, None), (2000, 6)):
        want = {(r.query_id, r.rank): (r.chunk_id, round(r.score, 6)) for r in store.search(queries, k, digits=digits, exact=True).filter("query_id < 13").collect()}
        got = {(r.query_id, r.rank): (r.chunk_id, round(r.score, 6)) for r in store.search(queries, k, digits=digits, certain=True).collect()}
        assert got == want and len(want) == 13 * min(k, 1510)
    approximate = {(r.query_id, r.rank): (r.chunk_id, round(r.score, 6)) for r in store.search(queries, 10, digits=6).collect()}
    assert approximate != {(r.query_id, r.rank): (r.chunk_id, round(r.score, 6)) for r in store.search(queries, 10, digits=6, exact=True).filter("query_id < 13").collect()}
