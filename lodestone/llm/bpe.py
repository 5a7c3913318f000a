"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut in pre-tokens. A group of documents (some tens of MB of whole texts of one task) numbers its distinct words;
its pre-tokens stay behind by position, as numbers, in chunks. The distinct words of the groups go through one shuffle
by word, where each is merged once. The ids come back to the groups, are joined to the positions, and the documents
reassembled. Decoding joins ids to the table of token bytes, which is of the vocabulary's size: a look-up by rank.
Words travel packed, one row per group and bucket of words: a word that stands in every text costs a few bytes a group.

Defined results: null counts as empty text; empty texts have no ids and decode to nothing; rows that repeat give
equal rows; null ids stay null; an empty table gives an empty table; other columns are not read. The input must be a
table or a stored frame: one plan reads its rows twice, and a mark of each group's words makes a changed order an error.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, read_table, text_rows

#: A chunk of positions takes whole texts until it holds so many characters, a group of chunks until it holds so many.
CHUNK_CHARS, GROUP_CHARS = 2 << 20, 48 << 20
#: Buckets of words: for each shuffle partition, and at least and at most, so that a row of a group holds several words.
BUCKETS_PER_PARTITION, LEAST_BUCKETS, MOST_BUCKETS = 4, 1024, 8192
#: A worker forgets the words of a bucket when it holds so many: they are merged again then.
REMEMBERED = 500_000
#: Texts of more characters are cut in pre-tokens one at a time.
LONG_TEXT = 1 << 20
SEQS = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("at", pa.int32()), ("mark", pa.int64()), ("n", pa.int32()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("seq", pa.binary())])
WORDS = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("mark", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("numbers", pa.binary()), ("words", pa.binary())])
ENCODED = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("mark", pa.int64()), ("n", pa.int32()), ("numbers", pa.binary()), ("ids", pa.binary())])
IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def sql_schema(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Packer:
    """Numbers below 2**32 as planes of bytes, so that equal high bytes stand together, and compressed."""

    def __init__(self) -> None:
        self.press, self.open = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()

    def pack(self, *arrays: np.ndarray) -> bytes:
        return self.press.compress(b"".join(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays))

    def unpack(self, data: bytes, *sizes: int, kind: type = np.int64) -> list[np.ndarray]:
        """Arrays of these sizes, and one of what is left."""
        raw, out, at = np.frombuffer(self.open.decompress(data), np.uint8), [], 0
        for n in [*sizes, len(raw) // 4 - sum(sizes)]:
            out.append(np.ascontiguousarray(raw[at : at + 4 * n].reshape(4, n).T).view("<u4").ravel().astype(kind))
            at += 4 * n
        return out


def chunked(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[list[tuple]]:
    """Rows (id, text) of a partition in chunks of whole texts."""
    rows, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            for ident, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                rows.append((ident, text or ""))
                size += len(text or "")
                if size >= limit:
                    yield rows
                    rows, size = [], 0
    if rows:
        yield rows


class Group:
    """What is known of a group of chunks: its words by number, in the order in which they came."""

    def __init__(self, no: int) -> None:
        self.no, self.chars, self.chunks, self.number = no, 0, 0, defaultdict(itertools.count().__next__)

    def words(self) -> list[bytes]:
        return [w.encode() for w in self.number]


def mark_of(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b"\0".join(words)) - (1 << 63)


def numbered(batches: Iterable[pa.RecordBatch], pattern: str, limit: int, group: int) -> Iterator[tuple[Group, list | None, list[int], np.ndarray | None]]:
    """Per chunk: its group, the ids, the number of pre-tokens of each text, and the pre-tokens as numbers; after a group's last chunk, the group alone.

    Both passes over the texts come to the same numbers as long as the input's rows come in the same order, which
    holds for tables; the mark of a group's words proves it.
    """
    compiled, own = regex.compile(pattern), Group(0)
    for rows in chunked(batches, limit):
        number = own.number.__getitem__
        seqs = [np.fromiter(map(number, compiled.findall(text) if len(text) < LONG_TEXT else (m.group() for m in compiled.finditer(text))), np.int32) for _, text in rows]
        yield own, [r[0] for r in rows], [len(s) for s in seqs], np.concatenate(seqs)
        own.chunks, own.chars = own.chunks + 1, own.chars + sum(len(text) for _, text in rows)
        if own.chars >= group:
            yield own, None, [], None
            own = Group(own.no + 1)
    if own.chunks:
        yield own, None, [], None


def _positions(batches: Iterable[pa.RecordBatch], pattern: str, limit: int, group: int) -> Iterator[pa.RecordBatch]:
    part, packer = TaskContext.get().partitionId(), Packer()
    for own, docs, counts, seq in numbered(batches, pattern, limit, group):
        if docs is None:  # closes the group
            row = {"at": -1, "mark": mark_of(own.words()), "n": len(own.number)}
        else:
            row = {"at": own.chunks, "docs": docs, "counts": counts, "seq": packer.pack(seq)}
        yield pa.RecordBatch.from_pylist([{"part": part, "no": own.no} | row], schema=SEQS)


def _words(batches: Iterable[pa.RecordBatch], pattern: str, limit: int, group: int, buckets: int) -> Iterator[pa.RecordBatch]:
    part, packer = TaskContext.get().partitionId(), Packer()
    for own, docs, _, _ in numbered(batches, pattern, limit, group):
        if docs is not None or not own.number:
            continue
        words = own.words()
        mark, bucket = mark_of(words), np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), np.int32, len(words))
        order = np.argsort(bucket, kind="stable")
        used, starts = np.unique(bucket[order], return_index=True)
        out = []
        for b, numbers in zip(used.tolist(), np.split(order, starts[1:]), strict=True):
            mine = [words[k] for k in numbers.tolist()]
            sizes = np.fromiter(map(len, mine), np.uint32, len(mine))
            text = packer.press.compress(sizes.tobytes() + b"".join(mine))
            out.append((part, own.no, mark, b, len(mine), packer.pack(np.diff(numbers, prepend=0)), text))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), WORDS, strict=True)], schema=WORDS)


def single_piece_encoder(ranks: dict[bytes, int]):
    """str -> ids, the whole string as one pre-token."""
    return tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _merge(batches: Iterable[pa.RecordBatch], ranks: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: each distinct word of a bucket is merged once; ids take the words' place."""
    table, known, packer, here = ranks.value, {}, Packer(), None
    encode = single_piece_encoder(table)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out = []
            for part, no, mark, bucket, n, numbers, packed in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                if bucket != here or len(known) > REMEMBERED:
                    known, here = {}, bucket
                data = packer.open.decompress(packed)
                ends = np.cumsum(np.frombuffer(data, np.uint32, n), dtype=np.int64) + 4 * n
                found, begin = [], 4 * n
                for end in ends.tolist():
                    word = data[begin:end]
                    ids = known.get(word)
                    if ids is None:
                        rank = table.get(word)
                        ids = known[word] = encode(word.decode()) if rank is None else (rank,)
                    found.append(ids)
                    begin = end
                counts = np.fromiter(map(len, found), np.uint32, n)
                out.append((part, no, mark, n, numbers, packer.pack(counts, np.fromiter(itertools.chain.from_iterable(found), np.uint32))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ENCODED, strict=True)], schema=ENCODED)


def joined(seqs: pa.Table, encoded: pa.Table) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """All of one group, chunk by chunk: the documents, where their ids end, and the ids, words' ids joined to positions."""
    packer, numbers, counts, pieces = Packer(), [], [], []
    closing = [(m, n) for at, m, n in zip(*(seqs[c].to_pylist() for c in ("at", "mark", "n")), strict=True) if at < 0]
    if len(closing) != 1 or set(encoded["mark"].to_pylist()) - {closing[0][0]}:
        raise ValueError("the input's rows came in another order the second time; store it first")
    for n, own, packed in zip(*(encoded[c].to_pylist() for c in ("n", "numbers", "ids")), strict=True):
        numbers.append(np.cumsum(packer.unpack(own)[-1]))
        count, ids = packer.unpack(packed, n, kind=np.int32)
        counts.append(count)
        pieces.append(ids)
    number, count, ids = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (numbers, counts, pieces))
    place = np.argsort(number)
    if not np.array_equal(number[place], np.arange(closing[0][1])):
        raise ValueError("a group's words are missing")
    first, count = (np.cumsum(count) - count)[place].astype(np.int32), count[place]
    for at, docs, sizes, packed in sorted(zip(*(seqs[c].to_pylist() for c in ("at", "docs", "counts", "seq")), strict=True), key=lambda x: x[0]):
        if at < 0:
            continue
        seq = packer.unpack(packed, kind=np.int32)[-1]
        n = count[seq]
        ends = np.cumsum(n, dtype=np.int64)
        # position i of the chunk takes the id at (first of its word) + (i - begin of its word's copy)
        shift = np.repeat((first[seq] - (ends - n)).astype(np.int32), n)
        shift += np.arange(len(shift), dtype=np.int32)
        yield docs, np.append(0, ends)[np.cumsum(sizes, dtype=np.int64)], ids[shift]


def _reassemble(seqs: pa.Table, encoded: pa.Table) -> pa.Table:
    docs, offsets, parts = [], [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
    for own, ends, ids in joined(seqs, encoded):
        docs += own
        offsets.append(ends + offsets[-1][-1])
        parts.append(ids)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets), pa.int32()), pa.array(np.concatenate(parts), pa.int32()))
    return pa.table([pa.array(docs, pa.int64()), lists], schema=IDS)


def _digested(seqs: pa.Table, encoded: pa.Table, ranks: Broadcast) -> pa.Table:
    """As _reassemble, but each document's ids are decoded and digested where they are put together, and don't leave the worker."""
    token, out = decoder(ranks.value).__getitem__, [[], [], [], []]
    for own, ends, ids in joined(seqs, encoded):
        begin = 0
        for doc, end in zip(own, ends.tolist(), strict=True):
            mine = ids[begin:end]
            decoded = hashlib.sha256(b"".join(map(token, mine.tolist()))).hexdigest()
            for c, v in zip(out, (doc, end - begin, hashlib.sha256(mine.astype("<u4").tobytes()).hexdigest(), decoded), strict=True):
                c.append(v)
            begin = end
    return pa.table([pa.array(c, f.type) for c, f in zip(out, DIGESTS, strict=True)], schema=DIGESTS)


def _cogrouped(docs: DataFrame, ranks: Broadcast, finish: Callable, schema: str, *, pattern: str = public_tokenizers.PATTERN, chunk_chars: int = CHUNK_CHARS, group_chars: int = GROUP_CHARS) -> DataFrame:
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, BUCKETS_PER_PARTITION * partitions(docs.sparkSession)))
    texts = text_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    over = functools.partial(functools.partial, pattern=pattern, limit=chunk_chars, group=group_chars)
    words = texts.mapInArrow(over(_words, buckets=buckets), sql_schema(WORDS)).repartition("bucket").sortWithinPartitions("bucket")
    encoded = words.mapInArrow(functools.partial(_merge, ranks=ranks), sql_schema(ENCODED))
    seqs = texts.mapInArrow(over(_positions), sql_schema(SEQS))
    return seqs.groupBy("part", "no").cogroup(encoded.groupBy("part", "no")).applyInArrow(finish, schema)


def encode(docs: DataFrame, ranks: Broadcast, **options) -> DataFrame:
    """Rows (doc_id, ids array<int>), one for each row of docs (doc_id, text), a table or a stored frame.

    The texts are read twice, once for the words and once for the positions: that costs less than to store either.
    """
    return _cogrouped(docs, ranks, _reassemble, sql_schema(IDS), **options)


def decoder(ranks: dict[bytes, int]) -> list[bytes]:
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _decode(batches: Iterable[pa.RecordBatch], ranks: Broadcast) -> Iterator[pa.RecordBatch]:
    token = decoder(ranks.value).__getitem__
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(map(token, ids or ())) for ids in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "content"])


def decode(encoded: DataFrame, ranks: Broadcast) -> DataFrame:
    """Rows (doc_id, ids) to (doc_id, content binary)."""
    return encoded.select("doc_id", "ids").mapInArrow(functools.partial(_decode, ranks=ranks), "doc_id long, content binary")


def encoded_digests(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Encodes and decodes: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    return _cogrouped(docs, ranks, functools.partial(_digested, ranks=ranks), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", **options)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
