"""Substring dedup with a compressed FM-index per shard.

A window is 13 consecutive words of a document. A word is removed if a window that covers it also starts in a
document with a smaller id. Every window has an anchor, the smallest hash of its 5-word grams, so that equal windows
have equal anchors:

1. Texts are read once and stored in chunks of whole documents, bucketed by the chunk's number, which all later steps know
   their documents by.
2. Chunks send their anchors, packed by bucket, to one shuffle, which returns those that documents with
   different texts share. What has no shared anchor is unique and goes no further.
3. Of equal texts, the documents with the smallest id send the runs of windows with shared anchors, as segments of
   words, to the shard of the anchor. Equal segments collapse before the shuffle to their smallest document.
4. Each shard builds an FM-index (wavelet matrix over the BWT) of its segments and streams them through backward
   search. Where the matching statistic reaches 13 words, the interval's smallest document is compared to the
   segment's own. Anchors with more than HOT_ANCHOR distinct segments would make one shard as large as the corpus has
   copies; their segments are cut again by anchors of longer grams, of 9 words and then of 13, and go to indexes of their own.
   An anchor of 13 words is the whole window, so that no shard grows beyond the bound.
5. Removed windows return to their chunks, whose texts are cut.

Words are compared by 64-bit hashes, of which segments carry 40 bits a word.

Defined results: null counts as no words, kept text empty; a null id counts as larger than all others; windows of rows
with the same id don't remove each other; a document of fewer than 13 words loses nothing; an empty table gives an
empty table; other columns are not read. The input's rows are read once, so their order and splits don't matter.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, discard, partitions, read_table, stored, text_rows
from .fm_index import FMIndex
from .graphs import group_starts, whole_groups
from .ngram_join import PLACES, WordHashes, mixed

WINDOW, GRAM = 13, 5
CHUNK_BYTES = 6 << 20
HOT_ANCHOR = 2_000
#: Words of segments for each FM-index.
SHARD_WORDS = 1 << 20
LAST = 2**63 - 1
WIDTH = 5  # bytes of a word's hash in a segment


class Chunk:
    """Whole texts of consecutive rows: their words' hashes, digests and anchors."""

    def __init__(self, rows: list[tuple[int | None, bytes | None]], hashes: WordHashes) -> None:
        self.ids, self.words, self.hashes, self.digests, self.anchors = [], [], [], [], []
        for ident, raw in rows:
            words = raw.split() if raw else []
            h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
            self.ids.append(ident)
            self.words.append(words)
            self.hashes.append(h)
            self.digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            self.anchors.append(anchors(h))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchors of all texts in order, with the digest of a text that has each, and whether texts of different digests do."""
        own = [np.unique(a) for a in self.anchors]
        flat = np.concatenate([np.zeros(0, np.uint64), *own])
        digest = np.repeat(np.frombuffer(b"".join(self.digests), "<i8")[::2], [len(a) for a in own])
        order = np.lexsort((digest, flat))
        flat, digest = flat[order], digest[order]
        start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(flat)) - 1 if len(start) else start
        return flat[start], digest[start], digest[start] != digest[end]


def anchors(h: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """For each window its smallest gram."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    grams = np.zeros(len(h) - gram + 1, np.uint64)
    for k in range(gram):
        grams += h[k : k + len(grams)] * PLACES[k]
    low, width, want = mixed(grams), 1, WINDOW - gram + 1
    while width * 2 <= want:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    return np.minimum(low[:n], low[want - width : want - width + n])


def chunks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list[tuple]]]:
    rows, size, no = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            for ident, raw in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                rows.append((ident, raw))
                size += len(raw or b"")
                if size >= limit:
                    yield no, rows
                    rows, size, no = [], 0, no + 1
    if rows:
        yield no, rows


def _table(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


TEXTS = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("digests", pa.binary()), ("sizes", pa.list_(pa.int32())), ("texts", pa.binary())])
ANCHORS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("numbers", pa.binary()), ("anchors", pa.binary()), ("digests", pa.binary())])
NOTES = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("numbers", pa.binary())])
SEGMENTS = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("ident", pa.int64()), ("start", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64()), ("words", pa.binary())])
FINER = pa.schema([("of_anchor", pa.int64()), ("of_content", pa.int64()), ("ident", pa.int64()), ("start", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64()), ("words", pa.binary())])
ANSWERS = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("low", pa.int64()), ("mask", pa.int64())])
#: Of an anchor's 48 bits that say whose it is, the one that says that different texts of a chunk have it.
SEVERAL = 1 << 47
SQL = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.int32()): "array<int>"}


def sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SQL[f.type]}" for f in schema)


def _pack(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Chunks of texts, compressed, with what else is needed of them; null as size -1."""
    part = TaskContext.get().partitionId()
    for no, rows in chunks(batches, limit):
        words = [raw.split() if raw else [] for _, raw in rows]
        digests = b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words)
        sizes = [-1 if raw is None else len(raw) for _, raw in rows]
        text = zstandard.ZstdCompressor(level=3).compress(b"".join(raw or b"" for _, raw in rows))
        yield _table([[part << 32 | no], [[r[0] for r in rows]], [[len(w) for w in words]], [digests], [sizes], [text]], TEXTS)


def _rows(docs: list, sizes: list[int], text: bytes) -> list[tuple]:
    data, out, at = zstandard.ZstdDecompressor().decompress(text), [], 0
    for ident, size in zip(docs, sizes, strict=True):
        out.append((ident, None if size < 0 else data[at : at + size]))
        at += max(0, size)
    return out


def _six(x: np.ndarray) -> np.ndarray:
    """The low six bytes of numbers."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _anchors(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for k in range(batch.num_rows):
            name, *row = (c[k].as_py() for c in batch.columns)
            anchor, digest, several = Chunk(_rows(*row), hashes).distinct()
            bucket = (anchor % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            used, starts = np.unique(bucket[order], return_index=True)
            if not len(used):
                continue
            whose = (digest.view(np.uint64) & np.uint64(SEVERAL - 1)) | (several.astype(np.uint64) * np.uint64(SEVERAL))
            sizes = np.diff(np.append(starts, len(order)))
            columns = [_binary(x[order], sizes, width) for x, width in ((np.arange(len(anchor), dtype="<u4"), 4), (_six(anchor // np.uint64(buckets)), 6), (_six(whose), 6))]
            yield _table([pa.array(np.full(len(used), name)), pa.array(used), *columns], ANCHORS)


def _binary(data: np.ndarray, sizes: np.ndarray, width: int) -> pa.Array:
    """Values of `width` bytes as binaries of so many values each."""
    offsets = np.append(0, np.cumsum(sizes * width)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _bytes(column: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of binaries, one row each, and how many each binary has."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data.reshape(-1, width), np.diff(offsets) // width


def _numbers(column: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same as numbers."""
    data, sizes = _bytes(column, width)
    return np.pad(data, ((0, 0), (0, 8 - width))).view("<u8").ravel(), sizes


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's anchors, the numbers of those that different texts share, chunk by chunk."""
    for table in whole_groups(batches, ["bucket"], 4000):
        starts, n = group_starts(table, ["bucket"]), table.num_rows
        (anchor, sizes), (whose, _), (number, _) = _numbers(table["anchors"], 6), _numbers(table["digests"], 6), _numbers(table["numbers"], 4)
        bucket = np.repeat(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n))), sizes).astype(np.uint64)
        key = bucket << np.uint64(48) | anchor
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        digest, several = whose[order] & np.uint64(SEVERAL - 1), whose[order] >= np.uint64(SEVERAL)
        flag = (np.minimum.reduceat(digest, first) != np.maximum.reduceat(digest, first)) | np.logical_or.reduceat(several, first)
        mine = np.zeros(len(key), bool)
        mine[order] = np.repeat(flag, np.diff(np.append(first, len(key))))
        count = np.bincount(np.repeat(np.arange(n), sizes)[mine], minlength=n)
        some = count > 0
        if some.any():
            yield _table([pa.array(table["chunk"].to_numpy()[some]), pa.array(np.zeros(int(some.sum()), np.int32)), _binary(number[mine].astype("<u4"), count[some], 4)], NOTES)


def runs(anchor: np.ndarray, hit: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows in order, the first and the number of those that follow each other in one document with one anchor that hits, up to 9 at a time."""
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (hit[1:] != hit[:-1]) | (doc[1:] != doc[:-1]))[: len(anchor)]
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(anchor)))[hit[starts]]
    pieces = -(-lengths // 9)
    piece = 9 * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return np.repeat(starts[hit[starts]], pieces) + piece, np.minimum(9, np.repeat(lengths, pieces) - piece)


def cut_words(words: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """words[begin : begin + n] of each segment: their hash, and their bytes."""
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    own = words[np.repeat(begin, n) + place] & np.uint64((1 << 8 * WIDTH) - 1)
    content = mixed(np.add.reduceat(own * PLACES[place], first) + n.astype(np.uint64)) if len(n) else np.zeros(0, np.uint64)
    return content.view(np.int64), _binary(own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH], n, WIDTH)


def _segments(texts: pa.Table, notes: pa.Table) -> pa.Table:
    """The runs of windows with shared anchors in the documents that stand for their text."""
    shared, standing = ([np.frombuffer(x, "<u4") for x, k in zip(notes["numbers"].to_pylist(), notes["kind"].to_pylist(), strict=True) if k == kind] for kind in (0, 1))
    if not shared or not standing:
        return SEGMENTS.empty_table()
    chunk = Chunk(_rows(*(texts[c][0].as_py() for c in ("docs", "sizes", "texts"))), WordHashes())
    known = np.sort(chunk.distinct()[0][np.concatenate(shared)])
    at = np.concatenate(standing).astype(np.int64)
    lengths = np.array([len(chunk.anchors[k]) for k in at])
    anchor, words = np.concatenate([chunk.anchors[k] for k in at]), np.concatenate([chunk.hashes[k] for k in at])
    doc, window = np.repeat(np.arange(len(at)), lengths), np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    hit = known[np.minimum(np.searchsorted(known, anchor), len(known) - 1)] == anchor
    begin, n = runs(anchor, hit, doc)
    sizes = np.array([len(chunk.hashes[k]) for k in at])
    own, start = doc[begin], window[begin]
    content, packed = cut_words(words, (np.cumsum(sizes) - sizes)[own] + start, n + WINDOW - 1)
    ident = np.array([LAST if chunk.ids[k] is None else chunk.ids[k] for k in at], np.int64)
    columns = [np.full(len(begin), texts["chunk"][0].as_py()), at[own].astype(np.int32), ident[own], start.astype(np.int32), anchor[begin].view(np.int64), content]
    return pa.Table.from_batches([_table([*map(pa.array, columns), packed], SEGMENTS)], SEGMENTS)


def _finer(batches: Iterable[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    """Segments (anchor, content, low, words) cut again by anchors of longer grams."""
    for batch in batches:
        words, sizes = _numbers(batch.column("words"), WIDTH)
        base = np.cumsum(sizes) - sizes
        each = [anchors(words[b : b + n], gram) for b, n in zip(base.tolist(), sizes.tolist(), strict=True)]
        if not each:
            continue
        anchor, lengths = np.concatenate(each), sizes - WINDOW + 1
        doc, window = np.repeat(np.arange(len(sizes)), lengths), np.arange(len(anchor)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        begin, n = runs(anchor, np.ones(len(anchor), bool), doc)
        own, start = doc[begin], window[begin]
        content, packed = cut_words(words, base[own] + start, n + WINDOW - 1)
        of = [batch.column(c).to_numpy()[own] for c in ("anchor", "content", "low")]
        yield _table([*map(pa.array, (*of, start.astype(np.int32), anchor[begin].view(np.int64), content)), packed], FINER)


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, content, low, n, words), a shard after the other, to ANSWERS of those that occur more than once or lose a window: those that also start in a document smaller than low."""
    for table in whole_groups(batches, ["anchor"], SHARD_WORDS // 18):
        words, lengths = _numbers(table["words"], WIDTH)
        low = table["low"].to_numpy()
        index = FMIndex(words, lengths)
        found, place = index.matching_statistics(words, lengths, WINDOW)
        groups = index.group_starts(WINDOW)
        smallest = np.minimum.reduceat(low[index.owner[index.order]], groups)
        here = smallest[np.searchsorted(groups, place, "right") - 1]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        gone = (found == WINDOW) & (here < low[owner])
        offset = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        mask = np.bincount(owner[gone], 2.0 ** offset[gone], len(lengths)).astype(np.int64)
        some = (mask > 0) | (table["n"].to_numpy() > 1)
        yield _table([pa.array(x[some]) for x in (table["anchor"].to_numpy(), table["content"].to_numpy(), low, mask)], ANSWERS)


#: The windows that a segment loses, as bits: all of them if an equal segment stands in a smaller document.
LOST = "if(ident > low, shiftleft(1L, windows) - 1, mask)"
#: Hot anchors that every task gets, at most; more of them meet the segments in a shuffle.
MOST_HOT = 1_000_000


def wordless(segments: DataFrame) -> DataFrame:
    """Segments with the number of their windows in place of their words, which are most of their bytes and needed no more to take an answer."""
    return segments.withColumn("windows", F.expr(f"cast(octet_length(words) / {WIDTH} - {WINDOW - 1} as int)")).drop("words")


def answers(segments: DataFrame, hot_anchor: int, gram: int = GRAM) -> DataFrame:
    """ANSWERS for segments (ident, anchor, content, words), a stored frame; by FM-indexes throughout."""
    contents = stored(segments.groupBy("anchor", "content", "words").agg(F.min("ident").alias("low"), F.count("*").alias("n")), "contents")
    hot = contents.groupBy("anchor").agg(F.count("*").alias("segments")).filter(F.col("segments") > hot_anchor).select("anchor")
    cold, finer, searched = contents, None, None
    if gram < WINDOW and (n_hot := hot.limit(MOST_HOT + 1).count()):
        hot = F.broadcast(hot) if n_hot <= MOST_HOT else hot  # each has over hot_anchor contents
        cold, warm = contents.join(hot, "anchor", "left_anti"), contents.join(hot, "anchor", "left_semi")
        finer = stored(warm.select("anchor", "content", "low", "words").mapInArrow(functools.partial(_finer, gram=gram + 4), sql(FINER)), "finer")
        below = answers(finer, hot_anchor, gram + 4)
        lost = wordless(finer).join(below, ["anchor", "content"]).groupBy("of_anchor", "of_content").agg(F.sum(F.expr(f"shiftleft({LOST}, start)")).alias("mask"))
        lost = warm.select("anchor", "content", "low", "n").join(lost.toDF("anchor", "content", "mask"), ["anchor", "content"], "left")
        searched = lost.withColumn("mask", F.coalesce("mask", F.lit(0).cast("long"))).filter("n > 1 OR mask > 0").drop("n")
    dealt = cold.select("anchor", "content", "low", "n", "words").repartition("anchor").sortWithinPartitions("anchor")
    direct = dealt.mapInArrow(_search, sql(ANSWERS))
    out = stored(direct if searched is None else direct.unionByName(searched), "answers")
    discard(contents, *([finer, below] if finer is not None else []))
    return out


KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.binary())])


def _cut(texts: pa.Table, removed: pa.Table, with_text: bool) -> pa.Table:
    rows = _rows(*(texts[c][0].as_py() for c in ("docs", "sizes", "texts")))
    at, start, mask = (removed[c].to_numpy() for c in ("at", "start", "mask"))
    order = np.argsort(at, kind="stable")
    at, start, mask = at[order], start[order], mask[order]
    bounds = np.searchsorted(at, np.arange(len(rows) + 1))
    out: list[list] = [[] for _ in range(5)]
    for k, (ident, raw) in enumerate(rows):
        words = raw.split() if raw else []
        kept, gone = words, 0
        if bounds[k] < bounds[k + 1]:
            cover = np.zeros(len(words) + 1, np.int64)
            s, m = start[bounds[k] : bounds[k + 1]], mask[bounds[k] : bounds[k + 1]]
            if (m < 0).any():  # all windows of the document
                cover[:] = 1
            else:
                for bit in range(9):
                    own = s[(m >> bit) & 1 == 1] + bit
                    np.add.at(cover, own, 1)
                    np.add.at(cover, own + WINDOW, -1)
                cover = np.cumsum(cover)
            flags = cover[: len(words)] > 0
            gone = int(flags.sum())
            kept = [w for w, f in zip(words, flags.tolist(), strict=True) if not f]
        text = b" ".join(kept)
        for c, v in zip(out, (ident, len(words), gone, hashlib.sha256(text).hexdigest(), text if with_text else None), strict=True):
            c.append(v)
    return pa.Table.from_batches([_table(out, KEPT)], KEPT)


def substring_dedup(docs: DataFrame, *, with_text: bool = False, chunk_bytes: int = CHUNK_BYTES, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, n_words, n_removed, kept_sha256, kept_text), one for each row; kept_text only if asked for."""
    spark = docs.sparkSession
    rows = text_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    texts = bucketed(rows.mapInArrow(functools.partial(_pack, limit=chunk_bytes), sql(TEXTS)), "chunk", "texts")
    light = texts.select("chunk", "digests", F.posexplode(F.arrays_zip("docs", "n_words")).alias("at", "doc"))
    light = light.select("chunk", "at", F.coalesce("doc.docs", F.lit(LAST)).alias("ident"), F.expr("substring(digests, at * 16 + 1, 16)").alias("digest"), F.col("doc.n_words").alias("n_words"))
    light = stored(light, "digests")
    least = light.groupBy("digest").agg(F.min("ident").alias("low"))
    placed = light.filter(f"n_words >= {WINDOW}").join(least, "digest")
    # every window of a document whose text also stands in a smaller one is removed
    copies = placed.filter("ident > low").select("chunk", "at", F.lit(0).alias("start"), F.lit(-1).cast("long").alias("mask"))
    standing = placed.filter("ident = low").groupBy("chunk").agg(F.collect_list("at").alias("ats"))
    packed = texts.select("chunk", "docs", "sizes", "texts")
    anchored = packed.mapInArrow(functools.partial(_anchors, buckets=max(1024, 16 * partitions(spark))), sql(ANCHORS)).repartition("bucket").sortWithinPartitions("bucket")
    notes = anchored.mapInArrow(_shared, sql(NOTES)).unionByName(standing.mapInArrow(_as_notes, sql(NOTES)))
    segments = stored(packed.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(_segments, sql(SEGMENTS)), "segments")
    found = wordless(segments).join(answers(segments, hot_anchor), ["anchor", "content"]).select("chunk", "at", "start", F.expr(LOST).alias("mask")).filter("mask <> 0")
    out = packed.groupBy("chunk").cogroup(found.unionByName(copies).groupBy("chunk")).applyInArrow(functools.partial(_cut, with_text=with_text), sql(KEPT))
    return out if with_text else out.drop("kept_text")


def _as_notes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunk, ats = (c.to_pylist() for c in batch.columns)
        yield _table([chunk, [1] * len(chunk), [np.array(x, "<u4").tobytes() for x in ats]], NOTES)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS k, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS s FROM w WHERE len(w) >= 13),
first AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM windows JOIN first USING (s) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM w),
kept AS (SELECT words.doc_id, count(gone.k) AS n_removed, string_agg(word, ' ' ORDER BY words.k) FILTER (gone.k IS NULL) AS kept FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.k = words.k GROUP BY words.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
