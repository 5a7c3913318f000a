"""The folder source over a generated tree."""

import os
import random

import pytest

from lodestone.plans.ingest import incoming
from lodestone.sources import folder_source, readers


@pytest.fixture
def tree(tmp_path):
    rng, files = random.Random(3), {}
    for k in range(120):
        folder = "/".join(rng.choice(["a", "b", "_c", "d e", "é"]) for _ in range(rng.randint(0, 6)))
        files[f"{folder}/f{k}.{rng.choice(['md', 'py', 'bin', 'txt', 'TXT'])}".lstrip("/")] = os.urandom(rng.choice([0, 5, 3000]))
    files |= {"_under.md": b"seen", ".hidden.md": b"not", ".git/x.md": b"not", "a/.gitignore": b"skip*\n", "a/skipped.md": b"ignored"}
    for name, content in files.items():
        (tmp_path / "top" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "top" / name).write_bytes(content)
    return tmp_path / "top", files


@pytest.mark.parametrize("parts", [1, 5, 1000])
def test_every_file_once(spark, tree, parts):
    root, files = tree
    rows = folder_source.scan_folder(spark, str(root), parts=parts).collect()
    want = {n: c for n, c in files.items() if not any(p.startswith(".") for p in n.split("/"))}
    assert len(rows) == len(want)
    assert {r.relative: bytes(r.content) for r in rows if r.error is None} == want
    assert all(r.byte_size == len(want[r.relative]) for r in rows)


def test_subtrees_are_dealt(spark, tree):
    root, _ = tree
    assert folder_source.scan_folder(spark, str(root), parts=40).rdd.getNumPartitions() >= 40
    assert folder_source.scan_folder(spark, str(root), parts=1).rdd.getNumPartitions() == 1


def test_options(spark, tree):
    root, files = tree
    assert [(r.relative, bytes(r.content)) for r in folder_source.scan_folder(spark, str(root), contents="rules").collect()] == [("a/.gitignore", b"skip*\n")]
    assert {r.content for r in folder_source.scan_folder(spark, str(root), contents="none").collect()} == {None}
    large = {r.relative: r.error for r in folder_source.scan_folder(spark, f"file://{root}", most_bytes=100, extensions="txt,md").collect()}
    assert {n.rpartition(".")[2].lower() for n in large} == {"txt", "md"}
    assert {n for n, e in large.items() if e} == {n for n, c in files.items() if len(c) > 100 and n.lower().endswith(("txt", "md")) and not any(p.startswith(".") for p in n.split("/"))}


def test_read_folder_has_failures_as_rows(spark, tree):
    root, files = tree
    rows = readers.read_folder(spark, str(root), most_bytes=100)
    got = {r.path.removeprefix(f"file:{root}/"): r for r in rows.collect()}
    want = {n for n in files if n.rpartition(".")[2].lower() in ("md", "py", "txt") and not any(p.startswith(".") for p in n.split("/")) and n != "a/skipped.md"}
    failed = {n for n in want if len(files[n]) > 100}
    assert got.keys() == want and failed and {n for n, r in got.items() if r.text is None} == failed
    assert sorted(r.relative for r in readers.list_folder(spark, str(root)).collect()) == sorted(got)
    known = spark.createDataFrame([], "path string, content_hash string")
    assert {r.path for r in incoming(rows, known).filter("status = 'failed'").collect()} == {got[n].path for n in failed}


def test_an_empty_folder_and_none(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert folder_source.scan_folder(spark, str(tmp_path / "e")).count() == 0
    assert not folder_source.can_open(str(tmp_path / "x")) and not folder_source.can_open("viewfs://c/x")
