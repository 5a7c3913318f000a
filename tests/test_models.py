import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestone.operators.models import HttpEmbedder, HttpLlm, is_served
from lodestone.sources.readers import read_pages
from lodestone.sources.web import fetch_pages


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def say(self, code, body, kind="application/json"):
        self.send_response(code)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        pages = {"/api/tags": b"{}", "/page": "<title>Ü</title><p>x</p>".encode("latin-1")}
        self.say(200 if self.path in pages else 404, pages.get(self.path, b"gone"), "text/html; charset=latin-1")

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/api/embeddings":
            self.say(200, json.dumps({"embedding": [3.0 * len(asked["prompt"]), 4.0 * len(asked["prompt"])]}).encode())
        else:
            self.say(200, json.dumps({"response": f"{asked['system']}|{asked['prompt']}|{asked['stream']}"}).encode())


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_embedder_and_llm(spark, server):
    assert is_served(server) and not is_served("http://127.0.0.1:9")
    got = spark.createDataFrame([("ab",), ("",)], "t string").select(HttpEmbedder("m", 2, server).vectors(F.col("t")).alias("v")).collect()
    assert got[0].v == pytest.approx([0.6, 0.8]) and got[1].v == [0, 0]
    assert HttpLlm("m", server).generate("s", "p") == "s|p|False"
    with pytest.raises(ValueError, match="dimensions"):
        HttpEmbedder("m", 3, server).embed(["x"])


def test_fetch(spark, server):
    pages = fetch_pages(spark.createDataFrame([(f"{server}/page",), (f"{server}/none",), ("nonsense",)], "url string"))
    got = {r.url.rsplit("/", 1)[-1]: r for r in pages.collect()}
    assert got["page"].error is None and "404" in got["none"].error and got["nonsense"].html is None
    assert read_pages(pages.filter("html is not null")).first().title == "Ü"
