import ast
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import evidence, feed_chunks
from jobs.common import settings
from lodestone.operators.chunking import chunk_text
from lodestone.schemas import ChunkConfig

ROOT = Path(__file__).resolve().parent.parent.parent
SCHEMA = "doc_id bigint, text string, source string, batch string, status string, h string"
LONG = ". ".join(f"Sentence {k} has some more words than {k - 1}" for k in range(400)) + "."


def add(spark, folder, rows, at):
    """One more file in a folder, as old as `at` says."""
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    new = [p for p in Path(folder).glob("part-*.parquet") if p.stat().st_mtime > 1e9]
    for p in new:
        os.utime(p, (at, at))


def brute(texts, parts, **config):
    """Chunks of each document by the one-document function."""
    c = ChunkConfig(**config)
    out = []
    for i, text in texts.items():
        out += [(str(i), parts[i], k["ordinal"], k["char_start"], k["char_end"], k["token_count"], k["text"]) for k in chunk_text(text, "plain", c)]
    return sorted(out, key=repr)


def seen(spark, output):
    rows = feed_chunks.current(spark, output).select("id", "part", "ordinal", "char_start", "char_end", "token_count", "text")
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def ran(spark, tmp_path, **config):
    return feed_chunks.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), config)


FIRST = [(1, LONG, "hot"), (2, "Two. Three.", "hot"), (3, "", "007"), (4, "Gone later.", None), (5, None, "hot"), (None, "No id.", "hot"), (6, "Same text.", "hot"), (7, "Same text.", "hot"), (2, "Two. Three.", "hot")]


def test_feed_takes_only_what_is_new(spark, tmp_path):
    small = {"max_tokens": 40, "overlap_tokens": 10}
    add(spark, tmp_path / "in", FIRST, 100)
    first = ran(spark, tmp_path, **small)
    texts, parts = {1: LONG, 2: "Two. Three.", 4: "Gone later.", 6: "Same text.", 7: "Same text."}, {1: "hot", 2: "hot", 4: None, 6: "hot", 7: "hot"}
    assert seen(spark, str(tmp_path / "out")) == brute(texts, parts, **small)
    assert (first["batches"], first["rows_read"], first["rows_failed"], first["documents_new"], first["documents_changed"]) == (1, 9, 2, 6, 0)
    assert first["chunks_written"] == len(brute(texts, parts, **small))
    # nothing new, nothing done
    before = sorted(p.name for p in (tmp_path / "out").rglob("*.parquet"))
    assert ran(spark, tmp_path, **small)["batches"] == 0
    assert before == sorted(p.name for p in (tmp_path / "out").rglob("*.parquet"))
    # one document changes, one is emptied, one is new, one comes unchanged, one moves to another source with a new text
    add(spark, tmp_path / "in", [(1, LONG, "hot"), (2, "Two. Four.", "b"), (4, "", None), (8, LONG[:900], "c"), (5, "At last.", "hot")], 200)
    second = ran(spark, tmp_path, **small)
    texts |= {2: "Two. Four.", 4: "", 8: LONG[:900], 5: "At last."}
    parts |= {2: "b", 8: "c", 5: "hot"}
    assert seen(spark, str(tmp_path / "out")) == brute(texts, parts, **small)
    assert (second["batches"], second["rows_read"], second["documents_new"], second["documents_changed"]) == (1, 5, 2, 2)
    # back to an earlier text: still a change
    add(spark, tmp_path / "in", [(2, "Two. Three.", "hot")], 300)
    assert ran(spark, tmp_path, **small)["documents_changed"] == 1
    assert seen(spark, str(tmp_path / "out")) == brute(texts | {2: "Two. Three."}, parts | {2: "hot"}, **small)


def test_newest_file_of_a_batch_wins(spark, tmp_path):
    add(spark, tmp_path / "in", [(1, "Newer than the other.", "a")], 200)
    os.rename(tmp_path / "in", tmp_path / "held")
    add(spark, tmp_path / "in", [(1, "Older, though it sorts last.", "a"), (1, "Older.", "b")], 100)
    for p in (tmp_path / "held").glob("part-*.parquet"):
        os.rename(p, tmp_path / "in" / f"x{p.name}")
    assert ran(spark, tmp_path)["rows_read"] == 3
    assert [r[-1] for r in seen(spark, str(tmp_path / "out"))] == ["Newer than the other."]


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    """As after a failure between the two writes, and after both."""
    out, c = str(tmp_path / "out"), settings("feed_chunks")
    stamp = F.timestamp_seconds(F.lit(1))
    one = spark.createDataFrame([("1", LONG, "a"), ("2", "Short.", None)], "id string, text string, part string").withColumn("modified", stamp)
    two = spark.createDataFrame([("1", LONG + " More.", "a"), ("2", "Short.", None), ("3", "New.", "b")], "id string, text string, part string").withColumn("modified", stamp)
    feed_chunks.take(one, 0, out, c)
    figures = feed_chunks.take(two, 1, out, c)
    whole = seen(spark, out), sorted(map(tuple, feed_chunks.parts(spark, f"{out}/documents", feed_chunks.DOCUMENTS).collect()))
    assert feed_chunks.take(two, 1, out, c) == figures
    for p in (tmp_path / "out" / "documents" / "batch=1").glob("*.parquet"):
        p.unlink()
    assert feed_chunks.take(two, 1, out, c) == figures
    assert whole == (seen(spark, out), sorted(map(tuple, feed_chunks.parts(spark, f"{out}/documents", feed_chunks.DOCUMENTS).collect())))


def test_an_output_of_another_checkpoint(spark, tmp_path):
    for k in range(2):
        add(spark, tmp_path / "in", [(k, f"Text {k}.", "a")], 100 + k)
        ran(spark, tmp_path)
    with pytest.raises(Exception, match="belongs to another output"):
        feed_chunks.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "new checkpoint"))
    assert len(seen(spark, str(tmp_path / "out"))) == 2


def test_many_files_in_several_batches(spark, tmp_path):
    for k in range(5):
        add(spark, tmp_path / "in", [(k, f"Text {k}.", "a"), (100, f"Version {k}.", "b")], 100 + k)
    assert ran(spark, tmp_path, files_per_batch=2)["batches"] == 3
    assert {r[0]: r[-1] for r in seen(spark, str(tmp_path / "out"))} == {str(k): f"Text {k}." for k in range(5)} | {"100": "Version 4."}


def test_feed_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert ran(spark, tmp_path)["batches"] == 0
    assert seen(spark, str(tmp_path / "out")) == []


def test_unknown_settings_are_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="no setting colour"):
        ran(spark, tmp_path, colour=1)


# Evidence


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(path))
    return str(path)


DOCS = [(i, f"The {w} stands alone in field {i}. Its colour is {c}.", s) for i, (w, c, s) in enumerate([("oak", "green", "a"), ("elm", "brown", "a"), ("fir", "dark", None), ("yew", "red", "b")])]
DOCS += [(10 + i, "Copies of one passage about larches and their needles, which fall in autumn.", "b") for i in range(40)] + [(60, None, "a"), (61, "", "a"), (None, "oak oak oak", "a"), (0, DOCS[0][1], "a")]


def test_evidence(spark, tmp_path):
    questions = write(spark, tmp_path / "q", [(1, "which oak stands"), (2, "needles of larches"), (3, "zzz"), (4, None), (None, "oak"), (1, "which oak stands")], "item_id bigint, text string")
    documents, out = write(spark, tmp_path / "d", DOCS, "doc_id bigint, text string, source string"), str(tmp_path / "out")
    figures = evidence.run(spark, questions, documents, out)
    rows = evidence.parts(spark, f"{out}/evidence", evidence.EVIDENCE).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in rows][:1] == [("1", "0")]
    assert [r.id for r in rows if r.query_id == "2"] == ["10"]  # one of forty copies
    for r in rows:
        assert dict((str(d[0]), d[1]) for d in DOCS if d[0] is not None)[r.id].encode()[r.char_start : r.char_end].decode() == r.text
    told = {r.query_id: (r.n_evidence, r.tokens) for r in evidence.parts(spark, f"{out}/questions", evidence.QUESTIONS).collect()}
    assert told.keys() == {"1", "2", "3", "4"} and told["3"] == told["4"] == (0, 0)
    assert figures == {"chunks": 44, "evidence": len(rows), "questions": 4}
    # a rerun with fewer documents leaves nothing of the first
    assert evidence.run(spark, questions, documents, out) == figures
    fewer = write(spark, tmp_path / "d2", DOCS[:1], "doc_id bigint, text string, source string")
    evidence.run(spark, questions, fewer, out)
    assert {r.id for r in evidence.parts(spark, f"{out}/evidence", evidence.EVIDENCE).collect()} == {"0"}


def test_evidence_keeps_to_its_budget(spark, tmp_path):
    questions = write(spark, tmp_path / "q", [(1, "oak elm fir yew stands alone")], "item_id bigint, text string")
    documents = write(spark, tmp_path / "d", DOCS[:4], "doc_id bigint, text string, source string")
    evidence.run(spark, questions, documents, str(tmp_path / "out"), {"budget": 30})
    rows = evidence.parts(spark, str(tmp_path / "out" / "evidence"), evidence.EVIDENCE).collect()
    assert 0 < sum(r.cost for r in rows) <= 30 and len(rows) == 2


def test_evidence_of_nothing(spark, tmp_path):
    questions = write(spark, tmp_path / "q", [(1, "oak")], "item_id bigint, text string")
    documents = write(spark, tmp_path / "d", [], "doc_id bigint, text string, source string")
    assert evidence.run(spark, questions, documents, str(tmp_path / "out")) == {"chunks": 0, "evidence": 0, "questions": 1}


def test_command_lines(spark, tmp_path):
    """Both jobs as a user starts them, with a settings file, twice."""
    write(spark, tmp_path / "in", DOCS[:4], "doc_id bigint, text string, source string")
    write(spark, tmp_path / "q", [(1, "oak")], "item_id bigint, text string")
    (tmp_path / "c.json").write_text(json.dumps({"max_tokens": 5, "overlap_tokens": 0}))
    run = lambda job, *args: subprocess.run([sys.executable, str(ROOT / "jobs" / job), *args, "--config", str(tmp_path / "c.json")], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    feed = ("--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "cp"))
    one, two = run("feed_chunks.py", *feed), run("feed_chunks.py", *feed)
    assert one.returncode == two.returncode == 0, one.stderr + two.stderr
    assert "in 1 batches, wrote 8 chunks of 4 new and 0 changed documents" in one.stderr and "in 0 batches" in two.stderr
    three = run("evidence.py", "--questions", str(tmp_path / "q"), "--documents", str(tmp_path / "in"), "--output", str(tmp_path / "ev"))
    assert three.returncode == 0 and "wrote 1 rows" in three.stderr, three.stderr


def test_jobs_stand_apart():
    """Nothing of the training-data operators or their pipeline is imported."""
    for path in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        names = [a.name for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Import) for a in n.names]
        names += [f"{n.module}.{a.name}" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom) for a in n.names]
        assert not [n for n in names if "llm" in n.split(".") or n.startswith("corpus_pipeline")]
