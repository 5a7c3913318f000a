"""SentencePiece encoding and decoding that keeps offsets.

A text is normalised by the longest prefixes that the model's compiled character map knows, and every byte of the
normalised text records where in the original it comes from. The normalised text is cut where no piece of the vocabulary
goes across, so that the parts merge on their own; each distinct part is merged once a task, by the library, with a model
that normalises nothing. Lengths of pieces add up to places in the normalised text, which the record projects back to
spans of bytes of the original. One pass over the texts in the map tasks, nothing is shuffled; a task holds a batch of
texts and a bounded number of parts.

Models: BPE with bytes for unknown characters, without symbols of the user's own; others are refused.

Defined results: null counts as empty text; empty texts have the ids of begin and end only, with empty spans at 0 and
at the end; a byte piece has an empty span but for the last one of its character, which has the character's; rows that
repeat give equal rows; null ids stay null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_rows

SPACE_MARK = "▁"
MARK_BYTES = np.frombuffer(SPACE_MARK.encode(), np.uint8)
#: A worker forgets the parts it has merged when it holds so many, or so many ids.
REMEMBERED, REMEMBERED_IDS = 400_000, 8_000_000
#: So many parts of a text are merged at once.
SOME_PARTS = 50_000
#: Longer parts are cut between characters that no piece has side by side.
LONG_PART = 200
#: Kinds of pieces, as the model file numbers them.
NORMAL, BYTE, USER_DEFINED = 1, 6, 4
ENCODED = "doc_id long, ids array<int>, begins array<long>, ends array<long>"


# The model file


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in protocol buffers' wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        size = {0: 0, 1: 8, 2: None, 5: 4}[kind]
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if size is None else size
        yield number, data[at : at + size]
        at += size


def message(parts: Iterable[tuple[int, int | bytes]]) -> bytes:
    """The reverse of fields(), for numbers and for values with a length."""

    def varint(value: int) -> bytes:
        out = bytearray()
        while value > 127:
            out.append(value & 127 | 128)
            value >>= 7
        return bytes([*out, value])

    return b"".join(varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v for n, v in parts)


#: Numbers of the fields of a model file that are read here.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
CHARS_MAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
MODEL_TYPE, SPACE_AS_SUFFIX, BYTE_FALLBACK, BPE = 3, 24, 35, 2


def decompiled(chars_map: bytes) -> dict[str, str]:
    """What a compiled character map replaces: a double array of 32-bit units over the bytes of the keys, and the replacements, ended by 0."""
    if not chars_map:
        return {}
    size = struct.unpack_from("<I", chars_map)[0]
    units, values = np.frombuffer(chars_map, "<u4", size // 4, 4), chars_map[4 + size :]
    label, offset = units & 0x800000FF, ((units >> 10) << ((units & 0x200) >> 6)).astype(np.int64)
    every, out, todo = np.arange(1, 256), {}, [(0, b"")]
    while todo:
        node, key = todo.pop()
        below = node ^ int(offset[node])
        if key and units[node] >> 8 & 1:
            at = int(units[below]) & 0x7FFFFFFF
            out[key.decode()] = values[at : values.index(b"\0", at)].decode()
        children = below ^ every
        children = children[children < len(units)]
        for child in children[label[children] == (children ^ below)].tolist():
            todo.append((child, key + bytes([child ^ below])))
    return out


class Normaliser:
    """Text to what the model merges, and for each of its bytes, and its end, the byte of the original that it stands for."""

    def __init__(self, replaced: dict[str, str], *, prefix: bool, remove_spaces: bool, escape: bool) -> None:
        if any("  " in v for v in replaced.values()):
            raise ValueError("a character map whose replacements hold two spaces in a row")
        self.replaced, self.prefix, self.remove_spaces, self.escape = replaced, prefix, remove_spaces, escape
        self.longest = max(map(len, replaced), default=0)
        first = "".join(sorted({re.escape(k[0]) for k in replaced}))
        self.affected = re.compile(f"[{first}]") if replaced else None

    def _prefix(self, text: str, at: int) -> tuple[str, str]:
        """What is replaced at a place, the longest key there or one character, and by what."""
        key = next((k for n in range(self.longest, 0, -1) if (k := text[at : at + n]) in self.replaced), None)
        return (text[at], text[at]) if key is None else (key, self.replaced[key])

    def _mapped(self, text: str) -> tuple[bytes, np.ndarray]:
        """The longest key at each place replaced, other characters as they are."""
        data = text.encode()
        if self.affected is None:
            return data, np.arange(len(data))
        parts, places, at, byte = [], [], 0, 0
        while m := self.affected.search(text, at):
            plain, at = text[at : m.start()].encode(), m.start()
            if plain:
                parts.append(plain)
                places.append(np.arange(byte, byte + len(plain)))
                byte += len(plain)
            taken, new = self._prefix(text, at)
            parts.append(new.encode())
            places.append(np.full(len(parts[-1]), byte))
            at, byte = at + len(taken), byte + len(taken.encode())
        parts.append(text[at:].encode())
        places.append(np.arange(byte, len(data)))
        return b"".join(parts), np.concatenate(places)

    def _lead(self, text: str) -> int:
        """How many bytes of the text stand for spaces at its begin, and for nothing else."""
        at = 0
        while at < len(text) and (one := self._prefix(text, at))[1] == " ":
            at += len(one[0])
        return len(text[:at].encode())

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        if not text:
            return "", np.zeros(1, np.int64)
        data, places = self._mapped(text)
        raw, end = np.frombuffer(data, np.uint8), len(text.encode()) if self.affected else len(data)
        if self.remove_spaces:
            space = raw == 32
            kept = ~(space & np.append(True, space[:-1])) if len(raw) else np.zeros(0, bool)
            raw, places = raw[kept], places[kept]
        if self.prefix and not (self.remove_spaces and not len(raw)):
            raw, places = np.append(np.uint8(32), raw), np.append(self._lead(text) if self.remove_spaces else 0, places)
        normal = raw.tobytes().decode()
        if self.escape:
            normal, places = normal.replace(" ", SPACE_MARK), np.repeat(places, np.where(raw == 32, len(MARK_BYTES), 1))
        if self.remove_spaces:  # marks that the text itself ends with go as well
            size = len(normal.encode())
            normal = normal.rstrip(SPACE_MARK if self.escape else " ")
            if (left := len(normal.encode())) < size:
                end, places = int(places[left]), places[:left]
        return normal, np.append(places, end)


def grown(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


class Pieces:
    """Encoder of a model file, which keeps the ids of parts it has merged by their number."""

    def __init__(self, model: bytes) -> None:
        self.forget()
        top = list(fields(model))
        normal, trainer = ({n: v for n, v in fields(next((v for m, v in top if m == of), b""))} for of in (NORMALIZER, TRAINER))
        kinds, pieces = [], []
        for number, value in top:
            if number == PIECES:
                one = dict(fields(value))
                pieces.append(one.get(1, b"").decode())
                kinds.append(one.get(3, NORMAL))
        if trainer.get(MODEL_TYPE) != BPE or not trainer.get(BYTE_FALLBACK) or trainer.get(SPACE_AS_SUFFIX) or USER_DEFINED in kinds:
            raise ValueError("only BPE models with bytes for unknown characters, spaces as prefixes and no symbols of the user's own")
        self.normalise = Normaliser(decompiled(normal.get(CHARS_MAP, b"")), prefix=bool(normal.get(DUMMY_PREFIX, 1)), remove_spaces=bool(normal.get(REMOVE_SPACES, 1)), escape=bool(normal.get(ESCAPE_SPACES, 1)))
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        # the same pieces with nothing left to normalise
        plain = message([(1, b"identity"), (DUMMY_PREFIX, 0), (REMOVE_SPACES, 0), (ESCAPE_SPACES, 0)])
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=message([(n, v) for n, v in top if n != NORMALIZER] + [(NORMALIZER, plain)]))
        self.lengths = np.array([1 if kind == BYTE else len(p.encode()) for p, kind in zip(pieces, kinds, strict=True)], np.int64)
        self.byte = np.array([int(p[3:5], 16) if kind == BYTE else -1 for p, kind in zip(pieces, kinds, strict=True)], np.int64)
        merged = [p for p, kind in zip(pieces, kinds, strict=True) if kind == NORMAL]
        self.neighbours = {pair for p in merged for pair in itertools.pairwise(p)}
        across = any(b == SPACE_MARK != a for a, b in self.neighbours)  # then only long texts are cut, between other characters
        self.part = re.compile("(?s).+" if across else f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()

    def forget(self) -> None:
        self.number = defaultdict(itertools.count().__next__)
        self.first, self.count, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32)
        self.known = self.used = 0

    def learn(self) -> None:
        """Merges the parts that got a number since the last time. Their ids stand in `flat`, as many as `count` says from `first` on."""
        new = list(itertools.islice(reversed(self.number), len(self.number) - self.known))[::-1]
        merged = self.merger.encode([part if len(part) <= LONG_PART else "" for part in new], num_threads=1)
        for k, part in enumerate(new):
            if len(part) > LONG_PART:
                cuts = [0, *(j + 1 for j, pair in enumerate(itertools.pairwise(part)) if pair not in self.neighbours), len(part)]
                merged[k] = list(itertools.chain.from_iterable(self.merger.encode([part[a:b] for a, b in itertools.pairwise(cuts)], num_threads=1)))
        counts = np.fromiter(map(len, merged), np.int64, len(new))
        ids = np.fromiter(itertools.chain.from_iterable(merged), np.int32)
        self.first, self.count, self.flat = (grown(x, size) for x, size in ((self.first, len(self.number)), (self.count, len(self.number)), (self.flat, self.used + len(ids))))
        self.first[self.known : len(self.number)] = self.used + np.cumsum(counts) - counts
        self.count[self.known : len(self.number)] = counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.known, self.used = len(self.number), self.used + len(ids)

    def ids(self, normal: str) -> np.ndarray:
        parts, found = self.part.findall(normal), [np.zeros(0, np.int32)]
        for at in range(0, len(parts), SOME_PARTS):
            numbers = np.fromiter(map(self.number.__getitem__, parts[at : at + SOME_PARTS]), np.int64)
            if len(self.number) > self.known:
                self.learn()
            count = self.count[numbers]
            ends = np.cumsum(count)
            # an id's place: the first of its part, and how far it is from its part's begin
            found.append(self.flat[np.repeat(self.first[numbers] - ends + count, count) + np.arange(ends[-1])])
            if len(self.number) > REMEMBERED or self.used > REMEMBERED_IDS:
                self.forget()
        return np.concatenate(found)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with begin and end, and where each begins and ends in the bytes of the text."""
        normal, places = self.normalise(text)
        ids = self.ids(normal)
        ends = np.cumsum(self.lengths[ids])
        if len(ends) and ends[-1] != len(places) - 1:
            raise ValueError("pieces don't add up to the text")
        begins, byte = ends - self.lengths[ids], self.byte[ids]
        spelt = byte >= 0
        first = spelt & ((byte & 0xC0) != 0x80)
        last = spelt & ~np.append(spelt[1:] & ~first[1:], np.zeros(min(len(ids), 1), bool))
        head = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))  # the first byte of a byte's character
        begins = np.where(spelt, begins[head], begins)
        ends = np.where(spelt & ~last, begins, ends)
        size = places[-1] if not len(text) else len(text.encode())
        begins, ends = places[begins], places[ends]
        return (np.concatenate([x, y, z]) for x, y, z in (([self.begin], ids, [self.end]), ([0], begins, [size]), ([0], ends, [size])))


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows]), kind))


#: A worker process keeps its encoder, and the parts it knows, from one task to the next.
KEPT: dict[bytes, Pieces] = {}


def kept(model: bytes) -> Pieces:
    if model not in KEPT:
        KEPT.clear()
        KEPT[model] = Pieces(model)
    return KEPT[model]


def _encode(batches: Iterable[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    pieces = kept(model.value)
    for batch in batches:
        at = 0
        while at < batch.num_rows:  # some MB of texts at a time
            rows, size, begin = [], 0, at
            while at < batch.num_rows and size < 4 << 20:
                text = batch.column(1)[at].as_py() or ""
                rows.append(tuple(pieces.encode(text)))
                size, at = size + len(text), at + 1
            lists = [_lists(list(c), kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, at - begin), *lists], names=["doc_id", "ids", "begins", "ends"])


def shared_model(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The model file's bytes, half a MB, for all tasks."""
    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model: Broadcast) -> DataFrame:
    """docs (doc_id, text) to (doc_id, ids, begins, ends), a row each: ids with begin and end, and each id's span in the bytes of the text."""
    texts = text_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return texts.mapInArrow(functools.partial(_encode, model=model), ENCODED)


def _decode(batches: Iterable[pa.RecordBatch], model: Broadcast, digests: bool) -> Iterator[pa.RecordBatch]:
    library = sentencepiece.SentencePieceProcessor(model_proto=model.value)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, out = batch.slice(at, 256), []
            for k, ident in enumerate(part.column(0).to_pylist()):
                ids, begins, ends = (part.column(c)[k].values.to_numpy() for c in (1, 2, 3))
                text = library.decode(ids)
                if digests:
                    spans = np.stack([begins, ends], axis=1).astype("<u8").tobytes()
                    out.append((ident, len(ids), *(hashlib.sha256(x).hexdigest() for x in (ids.astype("<u4").tobytes(), text.encode(), spans))))
                else:
                    out.append((ident, text))
            kinds = (pa.int64(), pa.int64(), *[pa.string()] * 3) if digests else (pa.int64(), pa.string())
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"] if digests else ["doc_id", "text"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def decode(encoded: DataFrame, model: Broadcast) -> DataFrame:
    """Rows of encode() to (doc_id, text)."""
    return encoded.mapInArrow(functools.partial(_decode, model=model, digests=False), "doc_id long, text string")


def encoded_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes: doc_id, n_tokens, ids_sha256, decoded_sha256, and spans_sha256 over each id's begin and end as 64-bit integers."""
    model = shared_model(docs.sparkSession, path)
    return encode(docs, model).mapInArrow(functools.partial(_decode, model=model, digests=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
