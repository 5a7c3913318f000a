"""Chunking: blocks by structure, segments by sentence or line, windows by token budget with overlap.

A window's start depends on where the one before ended, so this is an Arrow function of one document; documents
are independent. Offsets are bytes of UTF-8.
"""

from __future__ import annotations

import bisect
import io
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..schemas import ChunkConfig

CHUNKS = "array<struct<ordinal:int, text:string, token_count:int, structural_path:string, char_start:bigint, char_end:bigint>>"
ARROW = pa.list_(pa.struct([("ordinal", pa.int32()), ("text", pa.string()), ("token_count", pa.int32()), ("structural_path", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64())]))
SPACE = regex.compile(r"\s+")
#: Which code points are spaces; the last is 0x3000, and all above are as 0x3001.
BLANK = np.array([SPACE.match(chr(c)) is not None for c in range(0x3002)])
HEADING = regex.compile(r"(#{1,6}) (.*)", regex.DOTALL)


def _left(text: str) -> str:
    return text[m.end() :] if (m := SPACE.match(text)) else text


def _trim(text: str) -> str:
    return _left(_left(text)[::-1])[::-1]


def markdown_blocks(text: str) -> Iterator[tuple[int, int, str | None, bool]]:
    """(start, end, path, is code) of the prose between headings and fences, and of the fenced code, fences included."""
    headings: list[str] = []
    begin, at, fence = 0, 0, None
    for line in io.StringIO(text, newline="\n"):
        start, at, bare = at, at + len(line), _left(line)
        if bare.startswith("```"):
            if fence is None:
                if start > begin:
                    yield begin, start, " > ".join(headings) or None, False
                fence = start
            else:
                yield fence, at, " > ".join([*headings, "code"]), True
                begin, fence = at, None
        elif fence is None and (m := HEADING.match(bare)):
            if start > begin:
                yield begin, start, " > ".join(headings) or None, False
            del headings[len(m[1]) - 1 :]
            headings.append(_trim(m[2]))
            begin = start
    if begin < len(text):
        yield (begin, len(text), " > ".join(headings) or None, False) if fence is None else (fence, len(text), " > ".join([*headings, "code"]), True)


def segments(points: np.ndarray, blank: np.ndarray, dense: np.ndarray, start: int, end: int, code: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the segments of a block begin and end: sentences and paragraphs without the space before them, or lines of code. dense: where the text has no space."""
    part, space = points[start:end], blank[start:end]
    if code:
        last = part == 10
    else:
        line, after = part == 10, np.ones(len(part), bool)
        after[:-1] = space[1:]
        last = ((part == 46) | (part == 33) | (part == 63)) & after
        last[:-1] |= line[:-1] & line[1:]
    cuts = start + 1 + np.flatnonzero(last)
    begins, ends = np.concatenate([[start], cuts]), np.concatenate([cuts, [end]])
    if not code:
        begins = np.append(dense, len(points))[np.searchsorted(dense, begins)]
    return begins[begins < ends], ends[begins < ends]


def windows(tokens: list[int], most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(first, last) segments of each window: least last with `most` tokens; the next window re-reads `overlap` tokens at least, if it can and still move on."""
    n = len(tokens)
    before = [0, *itertools.accumulate(tokens)]  # tokens before each segment
    i = 0
    while i < n:
        j = min(n - 1, max(i, bisect.bisect_left(before, before[i] + most) - 1))
        yield i, j
        if j == n - 1:
            return
        # greatest k with before[j + 1] - before[k] >= overlap
        i = max(i + 1, min(j + 1 if overlap <= 0 else j, bisect.bisect_right(before, before[j + 1] - overlap) - 1))


def chunk_text(text: str, kind: str, config: ChunkConfig) -> list[dict]:
    """A text's chunks. Segments, their tokens and their ends come from arrays over the whole text, not from a search for each."""
    blocks = markdown_blocks(text) if kind == "markdown" else [(0, len(text), None, kind == "code")]
    ascii_only = text.isascii()
    points = np.frombuffer(text.encode(), np.uint8) if ascii_only else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = BLANK[points if ascii_only else np.minimum(points, len(BLANK) - 1)]
    dense = np.flatnonzero(~blank)
    size = None if ascii_only else np.concatenate([[0], np.cumsum(sum(((points >= x).view(np.uint8) for x in (0x80, 0x800, 0x10000)), np.uint8(1)), dtype=np.int64)])
    out: list[dict] = []
    for start, end, path, code in blocks:
        begins, ends = segments(points, blank, dense, start, end, code)
        first, last = np.searchsorted(dense, begins), np.searchsorted(dense, ends)
        tokens = np.where(last > first, np.maximum(1, (last - first) // 4), 0).tolist()
        for i, j in windows(tokens, config.max_tokens, config.overlap_tokens):
            if first[i] < last[j]:
                a, b = int(begins[i]), int(ends[j])
                body = text[dense[first[i]] : dense[last[j] - 1] + 1]
                out.append({"ordinal": len(out), "text": body, "token_count": sum(tokens[i : j + 1]), "structural_path": path, "char_start": a if size is None else int(size[a]), "char_end": b if size is None else int(size[b])})
    return out


def _chunked(texts: pa.Array, kinds: pa.Array, config: ChunkConfig) -> pa.Array:
    parts = []
    for begin, end in slices(texts):
        own = zip(*(c.slice(begin, end - begin).to_pylist() for c in (texts, kinds)), strict=True)
        parts.append(pa.array([chunk_text(t or "", k or "plain", config) for t, k in own], ARROW))
    return pa.concat_arrays(parts) if parts else pa.array([], ARROW)


def chunks(text: Column, kind: Column, config: ChunkConfig | None = None) -> Column:
    """The chunks of a text of kind markdown, code or plain, as an array of structs."""
    settings = config or ChunkConfig()
    return F.arrow_udf(lambda texts, kinds: _chunked(texts, kinds, settings), CHUNKS)(text, kind)


def chunk_documents(docs: DataFrame, config: ChunkConfig | None = None, *, document_id: str = "document_id", text: str = "text", kind: str = "text_kind", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of docs to one row a chunk, in the schema of the table chunk, and the document's columns to keep. Chunk ids sort by document and ordinal."""
    each = docs.select(F.col(document_id).cast("string").alias("document_id"), *keep, F.explode(chunks(F.col(text), F.col(kind), config)).alias("c"))
    locator = F.struct(
        F.lit("charspan").alias("kind"), F.lit(None).cast("int").alias("page"), F.col("c.char_start"), F.col("c.char_end"), F.lit(None).cast("array<float>").alias("bbox"),
        *[F.lit(None).cast(t).alias(n) for n, t in (("line_start", "bigint"), ("line_end", "bigint"), ("start_seconds", "double"), ("end_seconds", "double"))],
    )
    return each.select(F.concat("document_id", F.lit("#"), F.lpad(F.col("c.ordinal").cast("string"), 8, "0")).alias("id"), "document_id", "c.ordinal", "c.text", "c.token_count", "c.structural_path", locator.alias("locator"), *keep)
