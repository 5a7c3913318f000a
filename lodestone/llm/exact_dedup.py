"""Exact dedup by Patricia-trie owners.

Texts are equal when identical after replacing each run of spaces (0x20, 0x09 to 0x0D) by one space. Each map task
collapses what it sees in tries of its own, so that a text repeated a billion times crosses the shuffle once a batch.
Partitions by (length, content hash) then insert the full byte strings in compressed radix tries, whose terminal
nodes hold the smallest id and the number of rows: bytes decide, not digests. A trie that outgrows its memory spills
its largest subtree to a file of the task's own. The owners, one row a text, are joined back to the rows by digest;
a hot text splits in that join (AQE), as the owners' side has one row a key.

Defined results: null counts as empty text; all empty texts are equal; null ids are larger than all others, and a
group of null ids only has keep_id null and keeps all of its rows; rows that repeat an id in one group are all kept
or dropped alike; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, SPACES, read_table

#: Bytes of text that a task's tries hold before they spill a subtree.
TRIE_BYTES = 96 << 20
HEAD = struct.Struct(">qI")
RECORD = struct.Struct("<IqqB")


def normalised(raw: bytes | None) -> bytes:
    if not raw:
        return b""
    text = b" ".join(raw.split())
    if not text:
        return b" "
    return (b" " if raw[0] in SPACES else b"") + text + (b" " if raw[-1] in SPACES else b"")


class Trie:
    """Compressed radix trie over byte strings. A node: [label, children by first byte, smallest id, rows or 0]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None, 0]

    def insert(self, key: bytes, ident: int | None, rows: int = 1) -> int:
        """Returns the bytes that the trie grew by."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, ident, rows]
                return len(key) - at + 200
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            low, high = 1, min(len(label), len(key) - at)
            while low < high:  # the longest common prefix, by halving
                middle = (low + high + 1) // 2
                low, high = (middle, high) if key.startswith(label[:middle], at) else (low, middle - 1)
            fork: list = [label[:low], {label[low]: child}, None, 0]
            child[0] = label[low:]
            node[1][key[at]] = fork
            node, at = fork, at + low
        if ident is not None:
            node[2] = ident if node[2] is None else min(node[2], ident)
        node[3] += rows
        return 0

    def items(self, start: list | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(start or self.root, prefix)]
        while stack:
            (label, children, ident, rows), above = stack.pop()
            key = above + label
            if rows:
                yield key, ident, rows
            stack += [(child, key) for child in children.values()]


class SpillingTrie:
    """A trie whose subtrees below the first byte (at `depth` of the key) move to files when memory is short."""

    def __init__(self, limit: int = TRIE_BYTES, depth: int = 0) -> None:
        self.trie, self.limit, self.depth, self.held = Trie(), limit, depth, [0] * 256
        self.files: dict[int, tempfile._TemporaryFileWrapper] = {}

    def insert(self, key: bytes, ident: int | None, rows: int) -> None:
        at = key[self.depth]
        if at in self.files:
            self._append(at, key, ident, rows)
            return
        self.held[at] += self.trie.insert(key[self.depth :], ident, rows)
        if sum(self.held) > self.limit and self.depth < 7:
            self._spill(max(range(256), key=self.held.__getitem__), key[: self.depth])

    def _append(self, at: int, key: bytes, ident: int | None, rows: int) -> None:
        self.files[at].write(RECORD.pack(len(key), ident or 0, rows, ident is None) + key)

    def _spill(self, at: int, above: bytes) -> None:
        self.files[at], self.held[at] = tempfile.TemporaryFile(), 0
        for key, ident, rows in self.trie.items(self.trie.root[1].pop(at), b""):
            self._append(at, above + key, ident, rows)

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Keys of one trie share their first `depth` bytes, which are left out of what is yielded; texts follow the head."""
        for key, ident, rows in self.trie.items():
            yield key[HEAD.size - self.depth :], ident, rows
        for file in self.files.values():
            file.seek(0)
            below = SpillingTrie(self.limit, self.depth + 1)
            while head := file.read(RECORD.size):
                size, ident, rows, missing = RECORD.unpack(head)
                below.insert(file.read(size), None if missing else ident, rows)
            file.close()
            yield from below.items()


def _collapse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: rows (ident, text), some thousands at a time, to their distinct normalised texts with smallest id and number of rows."""
    for batch in (whole.slice(at, 2048) for whole in batches for at in range(0, max(1, whole.num_rows), 2048)):
        trie = Trie()
        for ident, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            trie.insert(normalised(raw), ident)
        texts, idents, rows = zip(*trie.items(), strict=True) if trie.root[1] or trie.root[3] else ((), (), ())
        yield pa.record_batch([pa.array([len(x) for x in texts], pa.int64()), pa.array([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in texts], pa.int64()), pa.array(texts, pa.binary()), pa.array(idents, pa.int64()), pa.array(rows, pa.int64())], names=["size", "hash", "content", "ident", "rows"])


OWNER_TYPES = {"sha": pa.string(), "keep_id": pa.int64(), "group_size": pa.int64()}


def _owners(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Reduce side: all partial groups of a text meet in one trie."""
    tries = SpillingTrie(limit)
    for batch in batches:
        for size, code, text, ident, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tries.insert(HEAD.pack(code, size & 0xFFFFFFFF) + text, ident, rows)
    found = ((hashlib.sha256(text).hexdigest(), ident, rows) for text, ident, rows in tries.items())
    while part := list(itertools.islice(found, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), OWNER_TYPES.values(), strict=True)], names=list(OWNER_TYPES))


def exact_owners(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: sha, keep_id (smallest id), group_size."""
    partial = docs.select(F.col("doc_id").cast("long").alias("ident"), "text").mapInArrow(_collapse, "size long, hash long, content binary, ident long, rows long")
    dealt = partial.repartition("size", "hash")
    return dealt.mapInArrow(functools.partial(_owners, limit=trie_bytes), "sha string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE_PATTERN, " ")
    rows = docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    both = rows.join(exact_owners(docs, trie_bytes), F.col("text_sha256") == F.col("sha"), "inner")
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
