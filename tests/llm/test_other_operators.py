import base64
import hashlib

import numpy as np
import pytest

from lodestone.llm import embedding_dedup, warc
from lodestone.llm.common import new_path, shared_dir
from lodestone.llm.graphs import components

from .conftest import found

PAGES = [(1, "http://a/\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "once"), (5, "u", "once"), (None, "u", "<p>é</p>"), (None, "v", "alone"), (6, "u", "y" * 100_000)]


def brute_pages(rows, least=0):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        owner = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        revisit = len(body) >= least and i != owner
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 6])
def test_warc(spark, least):
    pages, path = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as owner", "2 as address"), new_path(spark, "t")
    warc.write_archive(pages, path, min_revisit_bytes=least)
    archive = warc.read_archive(spark, path)
    assert found(archive.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == brute_pages(PAGES, least)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in PAGES})


def test_warc_records_round_trip(spark):
    pages, path = spark.createDataFrame(PAGES, "page_id long, url string, html string"), new_path(spark, "t")
    warc.write_archive(pages, path)
    records = [bytes(r.record) for r in warc.reconstruct(spark, path).collect()]
    assert len(records) == len(PAGES)
    for record in records:
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and len(rest) == int(fields[b"Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
    out = new_path(spark, "w")
    warc.export_warc(spark, path, out)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).collect()
    assert sum(bytes(f.content).count(b"WARC/1.1\r\n") for f in files) == len(PAGES)
    assert sorted(map(len, records)) and sum(len(f.content) for f in files) == sum(map(len, records))


def test_warc_notices_damage(spark):
    pages, path, other = spark.createDataFrame([(1, "u", "good")], "page_id long, url string, html string"), new_path(spark, "t"), new_path(spark, "t")
    warc.write_archive(pages, path)
    spark.read.parquet(f"{path}/payloads").selectExpr("address", "cast('evil' as binary) as payload").write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{other}/records")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, other).collect()


def test_warc_misses_no_payload(spark):
    """A record whose payload is gone is an error, wherever it is read."""
    pages, path, other = spark.createDataFrame([(1, "u", "one"), (2, "v", "two")], "page_id long, url string, html string"), new_path(spark, "t"), new_path(spark, "t")
    warc.write_archive(pages, path)
    spark.read.parquet(f"{path}/payloads").filter("payload <> cast('two' as binary)").write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{other}/records")
    for read in (warc.read_archive, warc.reconstruct):
        with pytest.raises(Exception, match="payload is missing"):
            read(spark, other).collect()


def test_warc_names_and_dates(spark):
    """Rows that share an id have records of their own names; every record has a date."""
    path = new_path(spark, "t")
    warc.write_archive(spark.createDataFrame([(1, "u", "a"), (1, "v", "a"), (1, "u", "b"), (0, "u", "a")], "page_id long, url string, html string"), path, date="2024-01-31T12:00:00Z")
    heads = [dict(line.split(": ", 1) for line in r.headers.strip().split("\r\n")[1:]) for r in warc.read_archive(spark, path).collect()]
    assert len({h["WARC-Record-ID"] for h in heads}) == 4 and {h["WARC-Date"] for h in heads} == {"2024-01-31T12:00:00Z"}
    assert [h["WARC-Refers-To"] in {x["WARC-Record-ID"] for x in heads} for h in heads if "WARC-Refers-To" in h] == [True]


def test_warc_long_page(spark):
    path, text = new_path(spark, "t"), "<p>é</p>" * 400_000
    warc.write_archive(spark.createDataFrame([(1, "u", text), (2, "v", text)], "page_id long, url string, html string"), path)
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc.read_archive(spark, path).collect()) == [(1, 3_600_000, "revisit"), (2, 3_600_000, "response")]


def test_warc_empty(spark):
    path = new_path(spark, "t")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).collect() == []


def near_rows(n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for k in range(0, n, 4):
        x[k + 1] = x[k] + 0.25 * rng.standard_normal(dim)
        x[k + 2] = 3 * x[k]
    x[300:] = x[300] + 0.1 * rng.standard_normal((n - 300, dim))  # a large group
    return [(k, [float(np.float32(v)) for v in row]) for k, row in enumerate(x)]


HARD = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [float("inf")] + [1.0] * 15), (1005, [None] + [1.0] * 15), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [1e-30] * 16), (1009, [1e30] * 16), (None, [1e30] * 16), (1009, [1e30] * 16)]


def brute_vectors(rows, threshold=0.95):
    good = lambda v: bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = {i: np.array(v) / np.max(np.abs(v)) for i, v in rows if i is not None and good(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    ids = sorted(unit)
    links, label = {i: 0 for i in ids}, {i: i for i in ids}
    near = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    for a, b in near:
        links[a] += 1
        links[b] += 1
    for _ in ids:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    return sorted(((i, links.get(i, 0), label.get(i, i), i == label.get(i, i)) for i, _ in rows), key=repr)


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 20])
def test_embedding_dedup(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = near_rows() + HARD
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rep", "2 as copies")
    assert found(embedding_dedup.near_vectors(vectors)) == brute_vectors(rows)


def test_embedding_dedup_empty(spark):
    assert found(embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))) == []


@pytest.mark.parametrize(("dim", "words", "least"), [(8, 16, 0.985), (64, 16, 0.999), (64, 95, 0.999), (64, 256, 0.998), (768, 16, 0.999), (768, 128, 0.998)])
def test_recall_at_the_threshold(dim, words, least):
    """Random pairs at cosine 0.95, the hardest that must be found, by codebook size."""
    rng, n = np.random.default_rng(5), 600
    a, r = rng.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r -= (r * a).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    met = [len(np.intersect1d(x, y)) > 0 for x, y in zip(embedding_dedup.directions(a, words), embedding_dedup.directions(b, words), strict=True)]
    assert np.mean(met) >= least


def test_embedding_dedup_exact(spark):
    rows = near_rows(320) + HARD
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(embedding_dedup.near_vectors(vectors, exact=True)) == brute_vectors(rows)


def test_components(spark):
    pairs = [(k, k + 1) for k in range(30)] + [(100, 200), (200, 50), (7, 7), (500, 500)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(31)}, 100: 50, 200: 50, 50: 50}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("path", [[1, *range(1000, 1, -1)], list(range(1, 1001))], ids=["down", "up"])
def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch, path):
    from lodestone.llm import graphs

    written, stored = [], graphs.stored
    monkeypatch.setattr(graphs, "stored", lambda df, name: (written.append(name), stored(df, name))[1])
    got = components(spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a long, b long")).collect()
    assert {r.node for r in got} == set(path) and {r.component for r in got} == {1}
    assert written.count("labels") - 1 <= 8
