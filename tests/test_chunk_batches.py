"""Texts are cut in slices by bytes."""

import tracemalloc

import pyarrow as pa

from lodestone.operators import chunking
from lodestone.schemas import ChunkConfig


def test_chunks_by_bytes():
    texts = pa.array([f"A sentence of text {k}. " * 2_500 for k in range(300)])
    kinds = pa.array(["markdown"] * 300)
    tracemalloc.start()
    chunking._chunked(texts, kinds, ChunkConfig())
    assert tracemalloc.get_traced_memory()[1] < 12e6
    tracemalloc.stop()
    few = texts.slice(3, 2)
    assert chunking._chunked(few, kinds.slice(3, 2), ChunkConfig()).to_pylist() == [chunking.chunk_text(t, "markdown", ChunkConfig()) for t in few.to_pylist()]
