"""An embedder and a language model behind a model server's HTTP interface. Workers call it; nothing is loaded here."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.vectors import TINY
from .services import Caller, Manners

# Where a local server listens, the models that are asked for, the length of its vectors, and its paths.
BASE_URL = "http://localhost:11434"
EMBED_MODEL, CHAT_MODEL, DIM = "nomic-embed-text", "llama3.1:8b-instruct-q4_0", 768
EMBED, GENERATE, LIST = "/api/embeddings", "/api/generate", "/api/tags"


def post(url: str, body: dict, timeout: float) -> dict:
    """Posts JSON and reads JSON; any answer but success is an error, so that the task is tried again."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def is_served(base_url: str = BASE_URL, timeout: float = 2) -> bool:
    """Whether a server answers there."""
    try:
        with urllib.request.urlopen(base_url + LIST, timeout=timeout) as answer:
            return 200 <= answer.status < 300
    except (OSError, urllib.error.URLError):
        return False


class HttpEmbedder:
    """Vectors of length 1 from a server, a request a text, several in flight."""

    def __init__(self, model_id: str, dim: int, base_url: str = BASE_URL, timeout: float = 60, manners: Manners | None = None) -> None:
        self.model_id, self.dim, self.base_url, self.timeout, self.manners = model_id, dim, base_url, timeout, manners or Manners()

    def _one(self, text: str | None) -> np.ndarray:
        v = np.array(post(self.base_url + EMBED, {"model": self.model_id, "prompt": text or ""}, self.timeout)["embedding"], np.float64)
        if len(v) != self.dim:
            raise ValueError(f"{self.model_id} gave {len(v)} dimensions, not {self.dim}")
        length = np.linalg.norm(v)
        return (v / length if length > TINY else v).astype(np.float32)

    def embed(self, texts: list[str | None]) -> list[np.ndarray]:
        found = Caller(self.manners).all(self._one, texts)
        for _, error in found:
            if error is not None:
                raise error
        return [v for v, _ in found]

    def vectors(self, text: Column) -> Column:
        embed = self.embed

        def run(texts: pa.Array) -> pa.Array:
            return pa.array(embed(texts.to_pylist()), pa.list_(pa.float32()))

        return F.arrow_udf(run, "array<float>")(text)


class HttpLlm:
    def __init__(self, model_id: str, base_url: str = BASE_URL, timeout: float = 600) -> None:
        self.model_id, self.base_url, self.timeout = model_id, base_url, timeout

    def generate(self, system: str, prompt: str) -> str:
        return post(self.base_url + GENERATE, {"model": self.model_id, "system": system, "prompt": prompt, "stream": False}, self.timeout)["response"]
