import pytest
from pyspark.sql import functions as F

from lodestone.operators.embedding import HashEmbedder
from lodestone.plans.answering import MockLlm
from lodestone.plans.ingest import ingest
from lodestone.plans.store import Conflict, Store
from lodestone.plans.workspace import Workspace
from lodestone.schemas import HybridConfig
from lodestone.sources.readers import list_folder, read_folder, read_texts
from lodestone.streaming import reingest

NOTES = {
    "garden.md": "# Beds\nCompost warms slowly, worms loosen clay, and beans climb the hazel poles by June.",
    "harbour.md": "# Tides\nThe pilot reads buoys and tide tables before the ferry leaves its berth.",
    "chess.md": "# Endings\nA rook behind the passed pawn wins tempo while the king walks to the centre.",
}


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    for name, text in NOTES.items():
        (root / name).write_text(text)
    return root


@pytest.fixture()
def workspace(spark, tmp_path):
    return Workspace(spark, f"file://{tmp_path}/ws", HashEmbedder(256))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def paths(df):
    return [r.path_or_url.rsplit("/", 1)[-1] for r in df.orderBy("rank").collect()]


def test_folder_search_and_hybrid(spark, workspace, folder):
    _, summary = workspace.add_folder_source(str(folder))
    assert (summary.documents_ingested, summary.documents_skipped, summary.chunks_created) == (3, 0, 3)
    assert paths(workspace.search(asked(spark, "worms compost clay beans"), 3))[0] == "garden.md"
    assert paths(workspace.search_hybrid(asked(spark, "rook passed pawn tempo king")))[0] == "chess.md"
    packed = workspace.search_hybrid(asked(spark, "passed pawn"), HybridConfig(budget=18)).collect()
    assert sum(r.cost for r in packed) <= 18
    assert workspace.store.read("source").first().status == "ready"


def test_again_changed_blank_and_removed(spark, workspace, folder):
    ident, _ = workspace.add_folder_source(str(folder))
    again, summary = workspace.add_folder_source(str(folder))
    assert again == ident and (summary.documents_ingested, summary.documents_skipped) == (0, 3)
    (folder / "garden.md").write_text("# Again\nNothing of the first draft is left here.")
    (folder / "chess.md").write_text("  \n")
    summary = workspace.sync_source(ident)
    assert (summary.documents_ingested, summary.documents_skipped, summary.chunks_created) == (1, 2, 1)
    left = workspace.store.read("document").collect()
    assert sorted(r.title for r in left) == ["garden.md", "harbour.md"]
    assert workspace.store.read("chunk").count() == workspace.store.read("chunk_vector").count() == workspace.store.read("embedding").count() == 2


def test_ignored_and_hidden_files(spark, workspace, tmp_path):
    root = tmp_path / "code"
    for name, text in {".lodestoneignore": "vendor/\n*.gen.ts\n", ".gitignore": "ignored.md\n", "keep.ts": "const a = 1;", "schema.gen.ts": "x", "vendor/lib.ts": "x", "ignored.md": "x", "kept.md": "x y", "c.png": "x", ".hidden/a.md": "x", "sub/.gitignore": "!deep.gen.ts", "sub/other.md": "y"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "broken.md").write_bytes(b"caf\xe9 ok")
    workspace.add_folder_source(str(root))
    assert sorted(r.title for r in workspace.store.read("document").collect()) == ["broken.md", "keep.ts", "kept.md", "other.md"]
    assert "caf� ok" in [r.text for r in workspace.store.read("chunk").collect()]


def test_pages_and_texts(spark, workspace):
    pages = spark.createDataFrame([("http://x/a", "<title>T</title><p>Bread and dough.</p>"), ("http://x/b", None)], "url string, html string")
    ident, summary = workspace.add_url_source("http://x", pages)
    assert (summary.documents_ingested, summary.documents_skipped) == (1, 1)
    assert workspace.sync_source(ident, pages).documents_ingested == 0
    _, summary = workspace.add_texts("memo", spark.createDataFrame([("m1", "one text"), ("m1", "one text"), ("m2", None)], "path string, text string"))
    assert (summary.documents_ingested, summary.documents_failed) == (1, 1)
    workspace.store.upsert("source", source_row(spark, "v", kind="youtube"))
    with pytest.raises(ValueError, match="can't be synced"):
        workspace.sync_source("v")
    with pytest.raises(ValueError, match="unrecognized git url"):
        workspace.add_repo_source("not a url")


def test_ask(spark, workspace, folder):
    workspace.add_folder_source(str(folder))
    best = workspace.search(asked(spark, "worms loosen clay"), 1).first().chunk_id
    workspace.llm = MockLlm(best)
    answers, citations = workspace.ask(asked(spark, "worms loosen clay", "zzzz qqqq"))
    by = {r.query_id: r for r in answers.collect()}
    assert not by[0].rejected and by[0].answer.endswith(f"[^{best}].") and by[1].rejected and "[^" not in by[1].answer
    used = [(r.query_id, r.chunk_id) for r in citations.filter("used_in_answer").collect()]
    assert used == [(0, best)] and citations.filter("query_id = 1").count() == 0
    store = workspace.store
    assert store.read("conversation").count() == 2 and store.read("message").count() == 4 and store.read("citation").filter("used_in_answer").count() == 1


def test_a_cited_chunk_may_change(spark, workspace, folder):
    ident, _ = workspace.add_folder_source(str(folder))
    workspace.ask(asked(spark, "worms loosen clay"))
    before = workspace.store.read("citation").count()
    (folder / "garden.md").write_text("# New\nother words")
    assert workspace.sync_source(ident).documents_ingested == 1
    assert workspace.store.read("citation").count() == before > 0


def test_failed_embedding_leaves_nothing(spark, workspace, folder):
    class Broken(HashEmbedder):
        def vectors(self, text):
            return F.when(text.contains("rook"), F.raise_error(F.lit("no"))).otherwise(super().vectors(text))

    workspace.embedder = Broken(256)
    with pytest.raises(Exception, match="no"):
        workspace.add_folder_source(str(folder))
    assert workspace.store.read("document").count() == 0 and workspace.store.read("source").first().status == "error"
    workspace.embedder = HashEmbedder(256)
    assert workspace.add_folder_source(str(folder))[1].documents_ingested == 3


def source_row(spark, ident, status="ready", kind="folder"):
    return spark.createDataFrame([(ident, kind, "u", status)], "id string, kind string, uri string, status string").selectExpr("*", "null as ingested_at", "null as last_synced_at", "'{}' as meta")


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.read("source").count() == 0
    store.upsert("source", source_row(spark, "a", "ingesting").union(source_row(spark, "b")))
    store.upsert("source", source_row(spark, "a"))
    assert {r.id: r.status for r in store.read("source").collect()} == {"a": "ready", "b": "ready"}
    with pytest.raises(Exception, match="outside its domain: kind"):
        store.upsert("source", source_row(spark, "c", kind="fax"))
    document = spark.createDataFrame([("d", "a", "p", "h"), ("e", "b", "q", "h")], "id string, source_id string, path_or_url string, content_hash string").selectExpr("*", "null as title", "null as mime", "1 as byte_size", "null as page_count", "0 as ingested_at")
    store.upsert("document", document)
    store.delete("source", spark.createDataFrame([("a",)], "id string"))
    assert [r.id for r in store.read("source").collect()] == ["b"] and [r.id for r in store.read("document").collect()] == ["e"]
    store.upsert("source", source_row(spark, "a"))
    assert store.tables() == ["document", "source"]
    with pytest.raises(Conflict):
        store.version = lambda: 0
        store.upsert("source", source_row(spark, "z"))


def test_upsert_takes_the_newest_of_a_batch(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("a", "old", 1), ("a", "new", 3), ("a", "mid", 2), ("b", "one", 1)], "key string, value string, at int").repartition(4)
    store.upsert("app_setting", rows, order="at")
    assert {r.key: r.value for r in store.read("app_setting").collect()} == {"a": "new", "b": "one"}
    store.upsert("app_setting", rows.filter("key = 'b'").union(rows.filter("key = 'b'")))  # equal rows are one
    with pytest.raises(Exception, match="rows that differ repeat the key a"):
        store.upsert("app_setting", rows)
    assert {r.key: r.value for r in store.read("app_setting").collect()} == {"a": "new", "b": "one"}


def test_a_crash_while_a_manifest_is_written(spark, tmp_path):
    """Neither an empty manifest, as older versions could leave it, nor a hidden one that was never renamed keeps a store from opening."""
    store = Store(spark, f"file://{tmp_path}/s")
    store.upsert("source", source_row(spark, "a"))
    commits = tmp_path / "s" / "commits"
    (commits / "000000000002.json").write_text("")
    (commits / ".000000000003-x").write_text('{"numb')
    again = Store(spark, store.path)
    assert [r.id for r in again.read("source").collect()] == ["a"] and again.version() == 2
    assert again.upsert("source", source_row(spark, "b")) == 3
    assert sorted(r.id for r in store.read("source").collect()) == ["a", "b"]
    again.version = lambda: 2
    with pytest.raises(Conflict):
        again.upsert("source", source_row(spark, "c"))  # the number is taken, and nothing of the attempt is left
    assert sorted(p.name for p in commits.iterdir() if not p.name.endswith(".crc")) == [".000000000003-x", "000000000001.json", "000000000002.json", "000000000003.json"]


def test_store_compacts(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    for k in range(6):
        store.upsert("source", source_row(spark, f"{k}").union(source_row(spark, "x", "ready" if k % 2 else "stale")))
    store.delete("source", spark.createDataFrame([("3",)], "id string"))
    want, files = sorted(store.read("source").collect()), len(store.read("source").inputFiles())
    # a delete and a row that are committed while the table is compacted stay
    whole = Store._read

    def meanwhile(self, table, state):
        monkeypatch.setattr(Store, "_read", whole)
        other = Store(spark, store.path)
        other.delete("source", spark.createDataFrame([("0",)], "id string"))
        other.upsert("source", source_row(spark, "new"))
        return whole(self, table, state)

    monkeypatch.setattr(Store, "_read", meanwhile)
    store.compact("source")
    assert {r.id for r in store.read("source").collect()} == {r.id for r in want} - {"0"} | {"new"}
    store.compact("source")
    assert len(store.read("source").inputFiles()) < files
    assert {r.id: r.status for r in store.read("source").collect()}["x"] == "ready"
    store.upsert("source", source_row(spark, "3"))
    assert "3" in {r.id for r in store.read("source").collect()}


def test_store_keeps_its_state(spark, tmp_path, monkeypatch):
    """Every STATE_EVERY-th manifest carries the state, so that the ones before need not be read."""
    from lodestone.plans import store as module

    monkeypatch.setattr(module, "STATE_EVERY", 3)
    store = Store(spark, f"file://{tmp_path}/s")
    for k in range(7):
        store.upsert("source", source_row(spark, f"{k}"))
    read, one = [], Store._manifest
    monkeypatch.setattr(Store, "_manifest", lambda self, n: read.append(n) or one(self, n))
    assert store.read("source").count() == 7 and min(read) == 6


def test_store_versions(spark, tmp_path, monkeypatch):
    from lodestone.plans import store as module

    store = Store(spark, f"file://{tmp_path}/s")
    store.upsert("source", source_row(spark, "a"))
    seen = []
    monkeypatch.setattr(module, "SCHEMA_VERSION", 2)
    monkeypatch.setitem(module.MIGRATIONS, 1, lambda s: seen.append(s.path))
    Store(spark, store.path)
    monkeypatch.setattr(module, "SCHEMA_VERSION", 0)
    with pytest.raises(ValueError, match="version 1"):
        Store(spark, store.path)
    assert seen == [store.path]


def test_ingest_notices_another_ingest(spark, workspace, folder, monkeypatch):
    """What was decided on by documents that another commit has changed since is not committed."""
    from lodestone.plans import ingest as module

    tally, store = module.tally, workspace.store

    def meanwhile(documents):
        monkeypatch.setattr(module, "tally", tally)
        module.ingest(store, "other", read_texts(spark.createDataFrame([("p", "some text")], "path string, text string")), workspace.embedder)
        return tally(documents)

    monkeypatch.setattr(module, "tally", meanwhile)
    with pytest.raises(Conflict):
        workspace.add_folder_source(str(folder))


def test_events(spark, workspace, folder):
    ident, _ = workspace.add_folder_source(str(folder))
    told = [(r.kind, r.path.rsplit("/", 1)[-1], r.outcome, r.documents_ingested) for r in workspace.events(ident).collect()]
    assert told == [("progress", name, "ingested", None) for name in sorted(NOTES)] + [("done", "", None, 3)]
    (folder / "chess.md").write_text("\n")
    workspace.sync_source(ident)
    assert [(r.kind, r.outcome) for r in workspace.events(ident).collect()][4:] == [("progress", "skipped"), ("done", None)]
    folded = reingest.latest_status(workspace.store.read("ingest_event"), "source_id", "at").collect()
    assert len(folded) == 1


def test_names_with_underscores_and_failures(spark, workspace, tmp_path):
    root = tmp_path / "site"
    for name in ("a.md", "__init__.py", "_posts/b.md", "_posts/_c.md", "sub/_drafts/d.txt", "sub/_e.png", ".hid/_f.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"text of {name}")
    names = ["__init__.py", "_posts/_c.md", "_posts/b.md", "a.md", "sub/_drafts/d.txt"]
    assert [r.relative for r in list_folder(spark, str(root)).collect()] == names
    read = {r.path.split("/site/")[1]: r.text for r in read_folder(spark, str(root)).collect()}
    assert read == {name: f"text of {name}" for name in names}
    # a file that is listed and can't be read
    (root / "gone.md").write_text("x")
    listed = list_folder(spark, str(root)).cache()
    assert listed.count() == 6
    (root / "gone.md").unlink()
    summary = ingest(workspace.store, "s", read_folder(spark, str(root)), workspace.embedder, expected=listed)
    assert (summary.documents_ingested, summary.documents_failed) == (5, 1)


def test_repo_and_url(spark, workspace, tmp_path):
    import subprocess

    origin = tmp_path / "host" / "team" / "notes.git"
    origin.mkdir(parents=True)
    git = lambda *a: subprocess.run(["git", "-C", str(origin), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    git("init")
    (origin / "_read.md").write_text("# Notes\nkept under version control")
    git("add", "-A")
    git("commit", "-m", "one")
    ident, summary = workspace.add_repo_source(f"file://{origin}")
    assert summary.documents_ingested == 1
    (origin / "more.md").write_text("a second file")
    git("add", "-A")
    git("commit", "-m", "two")
    assert workspace.sync_source(ident).documents_ingested == 1
    page = tmp_path / "page.html"
    page.write_text("<title>P</title><p>fetched text</p>")
    ident, summary = workspace.add_url_source(f"file://{page}")
    assert summary.documents_ingested == 1 and workspace.sync_source(ident).documents_skipped == 1
    page.unlink()
    assert workspace.sync_source(ident).documents_failed == 1


def test_open_detects_models(spark, tmp_path, monkeypatch):
    from lodestone.plans import workspace as module

    monkeypatch.setattr(module, "is_served", lambda url: url == "http://here")
    served, alone = (Workspace.open(spark, f"file://{tmp_path}/w", base_url=u) for u in ("http://here", "http://there"))
    assert type(served.embedder).__name__ == "HttpEmbedder" and type(served.llm).__name__ == "HttpLlm"
    assert type(alone.embedder).__name__ == "HashEmbedder" and alone.embedder.dim == served.embedder.dim == 768
    assert module.ping() == "pong" and module.version()


def test_index_is_kept_and_rebuilt(spark, workspace, folder, tmp_path):
    ident, _ = workspace.add_folder_source(str(folder))
    workspace.index()
    workspace.index()
    assert len(list((tmp_path / "ws" / "index").iterdir())) == 1
    (folder / "new.md").write_text("zebra crossing")
    workspace.sync_source(ident)
    assert paths(workspace.search_hybrid(asked(spark, "zebra")))[0] == "new.md"
    assert len(list((tmp_path / "ws" / "index").iterdir())) == 2


def test_vector_store(spark, workspace, folder):
    workspace.add_folder_source(str(folder))
    document = workspace.store.read("document").filter("title = 'chess.md'").select(F.col("id").alias("document_id"))
    workspace.vectors.delete_document(document)
    assert workspace.store.read("chunk_vector").count() == 2
    workspace.vectors.upsert(spark.createDataFrame([("c", "d", [1.0] * 256)], "chunk_id string, document_id string, vector array<float>"))
    assert workspace.vectors.search(spark.createDataFrame([(1, [1.0] * 256)], "query_id long, vector array<float>"), 1).first().chunk_id == "c"


def test_the_model_is_asked_once(spark, workspace, folder, tmp_path):
    """A model that never says the same twice: answers, messages and citations agree all the same."""
    workspace.add_folder_source(str(folder))
    best = workspace.search(asked(spark, "worms loosen clay"), 1).first().chunk_id

    class Moody:
        model_id = "moody"

        def generate(self, system, prompt):
            import uuid

            return f"{uuid.uuid4().hex} [^{best}]"

    workspace.llm = Moody()
    answers, _ = workspace.ask(asked(spark, "worms loosen clay"))
    first = answers.first().answer
    assert answers.first().answer == first == workspace.store.read("message").filter("role = 'assistant'").first().content


def test_stream(spark, tmp_path):
    store, at = Store(spark, f"file://{tmp_path}/s"), f"{tmp_path}/in"
    schema = "path string, text string"

    def feed(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(at)
        reingest.ingest_stream(reingest.stream_texts(spark, at, schema), store, "s", HashEmbedder(16), f"{tmp_path}/cp").awaitTermination()
        return {r.path_or_url: r.content_hash for r in store.read("document").collect()}

    first = feed([("a", "one text"), ("b", "two texts")])
    second = feed([("a", "one text"), ("b", "changed text"), ("c", "three")])
    assert set(first) == {"a", "b"} and set(second) == {"a", "b", "c"} and first["a"] == second["a"] and first["b"] != second["b"]


def test_status_fold(spark):
    events = [("s", 1, "progress"), ("s", 2, "done"), ("t", 1, "syncing"), ("t", 2, "progress"), ("u", 1, "failed"), ("v", 1, "syncing"), ("v", 2, "done"), ("v", 3, "progress")]
    got = reingest.latest_status(spark.createDataFrame(events, "id string, n int, kind string"), "id", "n").collect()
    assert dict(map(tuple, got)) == {"s": "ready", "t": "syncing", "u": "error", "v": "ingesting"}


def test_ticks(spark):
    q = reingest.ticks(spark, 1, 3).writeStream.format("memory").queryName("ticks").start()
    while spark.table("ticks").count() < 3:
        q.awaitTermination(1)
    q.stop()
    assert spark.table("ticks").count() == 3
