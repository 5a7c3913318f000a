"""LM scoring by a log-bilinear neural model with its words in classes.

Words fall in CLASSES classes: the end of a text, the most frequent words each alone, and classes by spelling for all
others. The VOCABULARY most frequent words are units of their class with vectors of their own; all other words of a class share one
more unit, its rest. A text's probability is the product over its tokens of

    P(class | the two classes before)  by a log-bilinear model: each context class's vector is turned by its place's
                                       matrix, the sum predicts a vector, a class scores its product with it plus a bias;
    P(unit | class, the class before)  by another within the class, unless the class is one word: products of the units' vectors
                                       with one of the class before, plus a bias;
    P(word | rest) = (c + 0.5) / (N + 0.5 * (V + 1)) with the counts of the class's rest, for words that are no units.

Both models are trained in numpy with noise-contrastive estimation on the counts of class trigrams, and of units after
classes, of all training documents: every few chunks of documents are a shard whose counts are kept; in each of ROUNDS
every shard takes gradient steps from the same parameters, and the results are averaged, weighted by tokens, in order of their tasks. Scores
are normalised: batched matrix products give the log-sum-exp of every pair of context classes, and of every class
after every other.

Counts of words are exact and cover all training documents. The vocabulary (a bounded table)
is broadcast; all rarer words, known or not, are looked up by one shuffle of each chunk's distinct words. Texts are split in
words once to be counted and once to be numbered; the numbers are stored, and all later steps know a document by its place there.

Defined results: null counts as empty text, which has one token, the end; a null id's text is the empty string, so the row
is a training row; rows that repeat count and score as rows of their own; without training rows every count is
0; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Packer
from .common import discard, partitions, read_table, stored, text_rows

#: Class 0 is the end of a text, and what stands before its first word.
SINGLE, SPELLING = 383, 128
CLASSES = 1 + SINGLE + SPELLING
#: Words with vectors of their own, each of up to LONGEST bytes.
VOCABULARY, LONGEST = 32_768, 64
WIDTH, ROUNDS, NOISE, BATCH, RATE = 24, 6, 4, 1 << 16, 0.1
#: The same within classes.
INNER, INNER_ROUNDS, INNER_RATE = 16, 2, 0.05
CHUNK_BYTES = 6 << 20
HELD_OUT = "crc32(encode(coalesce(cast(doc_id as string), ''), 'UTF-8')) % 5 = 1"
#: Workers that average shards' parameters before the driver does.
AVERAGERS = 4


def chunks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list[tuple]]]:
    rows, size, no = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            for ident, held, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                rows.append((ident, held, raw or b""))
                size += len(raw or b"")
                if size >= limit:
                    yield no, rows
                    rows, size, no = [], 0, no + 1
    if rows:
        yield no, rows


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of training rows with their numbers; the end is the empty word."""
    for _, rows in chunks(batches, CHUNK_BYTES):
        count: Counter = Counter()
        for _, held, raw in rows:
            if not held:
                count.update(raw.lower().split())
                count[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])


def spelling_class(word: bytes) -> int:
    return 1 + SINGLE + zlib.crc32(word[-2:]) % SPELLING


def top_words(counts: DataFrame, n: int) -> list[tuple[bytes, int]]:
    """The n most frequent words with their counts, ties by their bytes. Whole powers of two of the count are left out first."""
    bins = dict(counts.groupBy(F.floor(F.log2("c")).cast("int").alias("bin")).count().collect())
    total, least = 0, 0
    for at in sorted(bins, reverse=True):
        total, least = total + bins[at], at
        if total >= n:
            break
    return [(bytes(w), c) for w, c in counts.filter(F.col("c") >= F.lit(2.0) ** least).orderBy(F.desc("c"), "word").limit(n).select("word", "c").collect()]


class Vocabulary(dict):
    """Word to number: below `size` the vocabulary's, then this chunk's own."""

    def __init__(self, words: dict[bytes, int]) -> None:
        super().__init__(words)
        self.size = len(words)

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at

    def rare(self) -> list[bytes]:
        return list(self)[self.size :]


class Table:
    """What is broadcast: the vocabulary with log10(c + 0.5), its classes and units, and what the rests of classes hold.

    words: by falling count; the first SINGLE are classes of their own. rest: for each class by spelling the tokens and the distinct words
    of training rows that are no units.
    """

    def __init__(self, words: list[tuple[bytes, int]], rest: np.ndarray, tokens: int, types: int, ends: int) -> None:
        self.words = {w: k for k, (w, _) in enumerate(words)}
        count = np.array([c for _, c in words], np.float64)
        self.classes = np.array([k + 1 if k < SINGLE else spelling_class(w) for k, (w, _) in enumerate(words)], np.int32)
        self.logs = np.log10(count + 0.5)
        self.tokens, self.types, self.ends, self.normaliser = tokens, types, ends, np.log10(rest[:, 0] + 0.5 * (rest[:, 1] + 1))
        # units stand class by class, a class's rest first
        inner = np.arange(SINGLE, max(SINGLE, len(words)))
        cls = np.concatenate([np.arange(SPELLING), self.classes[inner] - 1 - SINGLE])
        order = np.argsort(cls, kind="stable")
        self.unit_class, self.unit_count = cls[order].astype(np.int32), np.concatenate([rest[:, 0], count[inner]])[order] + 0.5
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.rest, self.units = place[:SPELLING], np.append(np.full(min(SINGLE, len(words)), -1, np.int32), place[SPELLING:])
        self.first = np.searchsorted(self.unit_class, np.arange(SPELLING + 1))

    def unigram(self) -> np.ndarray:
        """Of classes, by tokens; none is 0."""
        out = np.ones(CLASSES)
        out[0] += self.ends
        single = 10 ** self.logs[:SINGLE] - 0.5
        out[1 : 1 + len(single)] += single
        out[1 + SINGLE :] += np.add.reduceat(self.unit_count - 0.5, self.first[:-1])
        return out / out.sum()


def contexts(classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all tokens of texts of so many words, ends included: the class two before, the one before, its own, and which are words.

    classes: of all words in order.
    """
    line = np.zeros(len(classes) + 2 * len(sizes) + 2, np.int64)
    token = np.zeros(len(line), bool)
    at = np.arange(len(classes)) + 2 + 2 * np.repeat(np.arange(len(sizes)), sizes)
    line[at], token[at] = classes, True
    token[np.cumsum(sizes) + 2 + 2 * np.arange(len(sizes))] = True
    at = np.flatnonzero(token)
    before = line[at - 1]
    return np.where(before > 0, line[at - 2], 0), before, line[at], line[at] > 0


NUMBERED = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("seq", pa.binary()), ("rare", pa.binary()), ("n_rare", pa.int32())])


def _number(batches: Iterable[pa.RecordBatch], table: Broadcast, limit: int) -> Iterator[pa.RecordBatch]:
    """Chunks of whole texts as numbers of words, with the chunk's own words in order of their numbers."""
    part, packer = TaskContext.get().partitionId(), Packer()
    for no, rows in chunks(batches, limit):
        own = Vocabulary(table.value.words)
        seqs = [np.fromiter(map(own.__getitem__, raw.lower().split()), np.int32) for _, _, raw in rows]
        rare = own.rare()
        yield _batch([[part << 32 | no], [[r[0] for r in rows]], [[r[1] for r in rows]], [packer.pack(np.array([len(s) for s in seqs]))], [packer.pack(np.concatenate(seqs))], [packer.press.compress(b" ".join(rare))], [len(rare)]], NUMBERED)


def opened(packer: Packer, table: Table, sizes: bytes, seq: bytes, rare: bytes, n_rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """A chunk's sizes of texts; its words as numbers, classes and units (-1 where the class is one word); and its own words."""
    sizes, seq = packer.unpack(sizes)[-1], packer.unpack(seq, kind=np.int32)[-1]
    words = packer.open.decompress(rare).split(b" ") if n_rare else []
    of_rare = np.fromiter(map(spelling_class, words), np.int32, len(words))
    classes = np.concatenate([table.classes, of_rare])[seq]
    return sizes, seq, classes, np.concatenate([table.units, table.rest[of_rare - 1 - SINGLE]])[seq], words


SHARDS = pa.schema([("tokens", pa.int64()), ("n", pa.int32()), ("data", pa.binary()), ("m", pa.int32()), ("inner", pa.binary())])


def _counts(batches: Iterable[pa.RecordBatch], table: Broadcast, each: int) -> Iterator[pa.RecordBatch]:
    """Of every few chunks' training rows: how often each trigram of classes occurs, and each unit after each class."""
    packer, t, held = Packer(), table.value, []

    def shard() -> pa.RecordBatch:
        (tri, n), (bi, m) = (np.unique(np.concatenate(x), return_counts=True) for x in zip(*held, strict=True))
        return _batch([[sum(len(x) for x, _ in held)], [len(tri)], [packer.pack(np.diff(tri, prepend=0), n)], [len(bi)], [packer.pack(np.diff(bi, prepend=0), m)]], SHARDS)

    for batch in batches:
        for row in batch.to_pylist():
            sizes, _, classes, units, _ = opened(packer, t, *(row[c] for c in ("sizes", "seq", "rare", "n_rare")))
            learn = ~np.array(row["held"], bool)
            mine = np.repeat(learn, sizes)
            classes, units = classes[mine], units[mine]
            a, b, c, word = contexts(classes, sizes[learn])
            inner = units >= 0
            held.append(((a * CLASSES + b) * CLASSES + c, b[word][inner] * len(t.unit_class) + units[inner]))
            if len(held) == each:
                yield shard()
                held = []
    if held and sum(len(x) for x, _ in held):
        yield shard()


class LogBilinear:
    """Parameters as one vector: word vectors and class vectors (CLASSES x WIDTH), two matrices, biases."""

    SHAPES = ((CLASSES, WIDTH), (CLASSES, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (CLASSES,))

    def __init__(self, flat: np.ndarray) -> None:
        sizes = [int(np.prod(s)) for s in self.SHAPES]
        self.flat = flat.astype(np.float32)
        self.r, self.q, self.c1, self.c2, self.b = (x.reshape(s) for x, s in zip(np.split(self.flat, np.cumsum(sizes)[:-1]), self.SHAPES, strict=True))

    @classmethod
    def start(cls, unigram: np.ndarray) -> LogBilinear:
        rng = np.random.default_rng(77)
        r, q = rng.normal(0, 0.1, (2, CLASSES, WIDTH))
        return cls(np.concatenate([r.ravel(), q.ravel(), np.eye(WIDTH).ravel(), np.eye(WIDTH).ravel(), np.log(unigram)]))

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """What a class scores for each class two before, and for each one before (CLASSES x CLASSES)."""
        return self.r @ self.c2.T @ self.q.T, self.r @ self.c1.T @ self.q.T

    def gradient(self, far: np.ndarray, near: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """From the gradients of the two products and the bias to that of the parameters."""
        e2, e1 = self.r @ self.c2.T, self.r @ self.c1.T
        d2, d1 = far @ self.q, near @ self.q
        return np.concatenate([(d2 @ self.c2 + d1 @ self.c1).ravel(), (far.T @ e2 + near.T @ e1).ravel(), (d1.T @ self.r).ravel(), (d2.T @ self.r).ravel(), bias]).astype(np.float32)

    def log_normalisers(self) -> np.ndarray:
        """log-sum-exp over classes of every context, a batch of matrix products."""
        far, near = self.products()
        out = np.empty((CLASSES, CLASSES), np.float32)
        for a in range(CLASSES):
            s = far[a][None, :] + near + self.b
            top = s.max(axis=1)
            out[a] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        return out


class InClass:
    """Parameters as one vector: the units' vectors (units x INNER), the context classes' (CLASSES x INNER), the units' biases."""

    def __init__(self, flat: np.ndarray, units: int) -> None:
        shapes = ((units, INNER), (CLASSES, INNER), (units,))
        self.flat = flat.astype(np.float32)
        self.u, self.e, self.b = (x.reshape(s) for x, s in zip(np.split(self.flat, np.cumsum([int(np.prod(s)) for s in shapes])[:-1]), shapes, strict=True))

    @classmethod
    def start(cls, count: np.ndarray) -> InClass:
        rng = np.random.default_rng(78)
        return cls(np.concatenate([rng.normal(0, 0.1, len(count) * INNER), rng.normal(0, 0.1, CLASSES * INNER), np.log(count)]), len(count))

    def scores(self, unit: np.ndarray, before: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.u[unit], self.e[before]) + self.b[unit]

    def log_normalisers(self, first: np.ndarray) -> np.ndarray:
        """log-sum-exp over the units of each class by spelling (whose units begin at `first`), after each class."""
        out = np.empty((SPELLING, CLASSES), np.float32)
        for k, (begin, end) in enumerate(zip(first[:-1], first[1:], strict=True)):
            s = self.u[begin:end] @ self.e.T + self.b[begin:end, None]
            top = s.max(axis=0)
            out[k] = top + np.log(np.exp(s - top).sum(axis=0))
        return out


def noise_table(unigram: np.ndarray) -> np.ndarray:
    """Classes in proportion to their frequency, each at least once: a draw is a random place of it."""
    return np.repeat(np.arange(CLASSES, dtype=np.int32), np.maximum(1, np.round(unigram * (1 << 18))).astype(np.int64))


def nce_steps(model: LogBilinear, code: np.ndarray, n: np.ndarray, table: np.ndarray, rng: np.random.Generator) -> None:
    """One pass over trigrams with their counts: data against NOISE draws from the noise table each."""
    square, log_noise = np.zeros_like(model.flat), np.log(NOISE * np.bincount(table, minlength=CLASSES) / len(table)).astype(np.float32)
    order = rng.permutation(len(code))
    for at in range(0, len(order), BATCH):
        k = order[at : at + BATCH]
        ab, c = np.divmod(code[k].astype(np.int32), np.int32(CLASSES))
        a, b = np.divmod(ab, np.int32(CLASSES))
        weight = (n[k] / n[k].sum()).astype(np.float32)
        far, near = (x.astype(np.float32).ravel() for x in model.products())
        bias, grads = model.b - log_noise, [np.zeros(CLASSES * CLASSES), np.zeros(CLASSES * CLASSES), np.zeros(CLASSES)]
        for draw in range(NOISE + 1):
            w = c if draw == 0 else table.take(rng.integers(0, len(table), len(k), dtype=np.int32))
            places = (a * np.int32(CLASSES) + w, b * np.int32(CLASSES) + w, w)
            g = 1 / (1 + np.exp(-np.clip(far.take(places[0]) + near.take(places[1]) + bias.take(w), -30, 30)))
            g = weight * (g - np.float32(draw == 0))
            for out, place in zip(grads, places, strict=True):
                out += np.bincount(place, g, len(out))
        g = model.gradient(grads[0].reshape(CLASSES, CLASSES), grads[1].reshape(CLASSES, CLASSES), grads[2])
        square += g * g
        model.flat -= RATE * g / (np.sqrt(square) + 1e-7)


def nce_inner(model: InClass, code: np.ndarray, n: np.ndarray, count: np.ndarray, first: np.ndarray, cls: np.ndarray, rng: np.random.Generator) -> None:
    """The same within classes: a unit against NOISE draws each from its class, by the units' counts."""
    units, square = len(count), np.zeros_like(model.flat)
    ends = np.cumsum(count)
    begin, share = np.append(0, ends)[first[:-1]], np.add.reduceat(count, first[:-1])
    log_noise = np.log(NOISE * count / share[cls]).astype(np.float32)
    order = rng.permutation(len(code))
    for at in range(0, len(order), BATCH):
        k = order[at : at + BATCH]
        before, unit = np.divmod(code[k], units)
        own = cls[unit]
        low, high = first[own], first[own + 1] - 1
        draws = [unit, *(np.clip(np.searchsorted(ends, begin[own] + rng.random(len(k)) * share[own], "right"), low, high) for _ in range(NOISE))]
        weight = (n[k] / n[k].sum()).astype(np.float32)
        places, gs = np.concatenate(draws), []
        for draw, w in enumerate(draws):
            g = 1 / (1 + np.exp(-np.clip(model.scores(w, before) - log_noise[w], -30, 30)))
            gs.append(weight * (g - np.float32(draw == 0)))
        g, after = np.concatenate(gs), np.tile(before, NOISE + 1)
        of_u, of_e = model.e[after] * g[:, None], model.u[places] * g[:, None]
        grad = [*(np.bincount(places, of_u[:, d], units) for d in range(INNER)), *(np.bincount(after, of_e[:, d], CLASSES) for d in range(INNER))]
        g = np.concatenate([np.stack(grad[:INNER], axis=1).ravel(), np.stack(grad[INNER:], axis=1).ravel(), np.bincount(places, g, units)]).astype(np.float32)
        square += g * g
        model.flat -= INNER_RATE * g / (np.sqrt(square) + 1e-7)


def _train(batches: Iterable[pa.RecordBatch], start: Broadcast, table: Broadcast, noise: Broadcast, seed: int, inner: bool) -> Iterator[pa.RecordBatch]:
    """A task's shards, each from the same parameters: their tokens, and parameters times tokens."""
    part, packer, t, tokens, total = TaskContext.get().partitionId(), Packer(), table.value, 0, None
    for batch in batches:
        for weight, n, data, m, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rng = np.random.default_rng([seed, weight, n])
            model = LogBilinear(start.value[0].copy())
            step, count = packer.unpack(data, n)
            nce_steps(model, np.cumsum(step), count, noise.value, rng)
            done = [model.flat]
            if inner:
                within = InClass(start.value[1].copy(), len(t.unit_class))
                step, count = packer.unpack(pairs, m)
                nce_inner(within, np.cumsum(step), count, t.unit_count, t.first, t.unit_class, rng)
                done.append(within.flat)
            flat = weight * np.concatenate(done).astype(np.float64)
            tokens, total = tokens + weight, flat if total is None else total + flat
    if tokens:
        yield _mean(part, tokens, total)


def _mean(part: int, tokens: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([tokens], pa.int64()), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())], names=["part", "tokens", "mean"])


def _add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, total, tokens = None, 0, 0
    for batch in batches:
        for at, weight, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = at if part is None else part
            total, tokens = total + weight * np.frombuffer(data, np.float32).astype(np.float64), tokens + weight
    if tokens:
        yield _mean(part, tokens, total)


def train(shards: DataFrame, table: Table, rounds: int = ROUNDS, inner_rounds: int = INNER_ROUNDS) -> tuple[LogBilinear, InClass]:
    """Rounds of passes over all shards from the same parameters, then their mean; units learn in the first of them.

    Means are added up in a tree, each task's in order of the tasks below it.
    """
    spark, columns = shards.sparkSession, "part int, tokens long, mean binary"
    context, model, within = spark.sparkContext, LogBilinear.start(table.unigram()), InClass.start(table.unit_count)
    noise, shared = context.broadcast(noise_table(table.unigram())), context.broadcast(table)
    for at in range(rounds):
        start = context.broadcast([model.flat, within.flat])
        done, n = shards.mapInArrow(functools.partial(_train, start=start, table=shared, noise=noise, seed=at, inner=at < inner_rounds), columns), partitions(spark)
        while n := max(AVERAGERS, n // 32):
            done = done.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_add, columns)
            if n == AVERAGERS:
                break
        parts = sorted(done.collect(), key=lambda p: p["part"])
        start.unpersist()
        if not parts:
            break
        flat = sum(p["tokens"] * np.frombuffer(p["mean"], np.float32).astype(np.float64) for p in parts) / sum(p["tokens"] for p in parts)
        model = LogBilinear(flat[: len(model.flat)])
        if at < inner_rounds:
            within = InClass(flat[len(model.flat) :], len(table.unit_class))
    return model, within


RARE = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("numbers", pa.binary()), ("words", pa.binary())])
PARTIAL = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("tokens", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("score", pa.list_(pa.float64())), ("rare", pa.list_(pa.int32())), ("seq", pa.binary())])
FOUND = pa.schema([("chunk", pa.int64()), ("data", pa.binary()), ("n", pa.int32())])
RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
KINDS = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean"}


def sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} " + (f"array<{KINDS[f.type.value_type]}>" if pa.types.is_list(f.type) else KINDS[f.type]) for f in schema)


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _rare(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's own words (chunk, rare, n_rare), packed by bucket."""
    packer = Packer()
    for batch in batches:
        for chunk, rare, n_rare in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not n_rare:
                continue
            words = packer.open.decompress(rare).split(b" ")
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))
            order = np.argsort(bucket, kind="stable")
            used, starts = np.unique(bucket[order], return_index=True)
            numbers = np.split(order, starts[1:])
            yield _batch([[chunk] * len(used), used.tolist(), [packer.pack(np.diff(x, prepend=0)) for x in numbers], [packer.press.compress(b" ".join(words[k] for k in x.tolist())) for x in numbers]], RARE)


def _look_up(rare: pa.Table, counts: pa.Table) -> pa.Table:
    """One bucket of words: the counts of those that occur in training rows."""
    packer, count = Packer(), dict(zip(counts["word"].to_pylist(), counts["c"].to_pylist(), strict=True))
    out: list[list] = [[] for _ in FOUND]
    for chunk, numbers, words in zip(*(rare[c].to_pylist() for c in ("chunk", "numbers", "words")), strict=True):
        c = np.fromiter((count.get(w, 0) for w in packer.open.decompress(words).split(b" ")), np.int64)
        hit = c > 0
        if hit.any():
            own = np.cumsum(packer.unpack(numbers)[-1])[hit]
            c = c[hit]
            for x, v in zip(out, (chunk, packer.pack(own, c & 0xFFFFFFFF, c >> 32), len(own)), strict=True):
                x.append(v)
    return pa.Table.from_batches([_batch(out, FOUND)], FOUND)


def _partial(batches: Iterable[pa.RecordBatch], table: Broadcast, model: Broadcast) -> Iterator[pa.RecordBatch]:
    """Scores of each chunk's rows but for the counts of rare words, and where those stand."""
    packer, t = Packer(), table.value
    far, near, bias, normaliser, within, inner_normaliser = model.value
    size, log_all, log_end = len(t.words), np.log10(t.tokens + 0.5 * (t.types + 1)), np.log10(t.ends + 0.5)
    for batch in batches:
        for r in batch.to_pylist():
            sizes, seq, classes, units, _ = opened(packer, t, *(r[c] for c in ("sizes", "seq", "rare", "n_rare")))
            n = len(sizes)
            a, b, c, word = contexts(classes, sizes)
            row = np.repeat(np.arange(n), sizes + 1)
            of = row[word]
            tokens = sizes + 1
            score = np.bincount(row, (far[a, c] + near[b, c] + bias[c] - normaliser[a, b]).astype(np.float64) / np.log(10), n)
            inner = units >= 0
            own, after = units[inner], b[word][inner]
            score += np.bincount(of[inner], (within.scores(own, after) - inner_normaliser[t.unit_class[own], after]).astype(np.float64) / np.log(10), n)
            rare = seq >= size
            score -= np.bincount(of[rare], t.normaliser[classes[rare] - 1 - SINGLE], n)
            base = np.bincount(of[~rare], t.logs[seq[~rare]], n) + (log_end - tokens * log_all)
            known = np.bincount(of[~rare], minlength=n) + (1 if t.ends else 0)
            yield _batch([[r["chunk"]], [r["docs"]], [r["held"]], [tokens.tolist()], [known.tolist()], [base.tolist()], [score.tolist()], [np.bincount(of[rare], minlength=n).tolist()], [packer.pack(seq[rare] - size)]], PARTIAL)


def _finish(partial: pa.Table, found: pa.Table) -> pa.Table:
    packer = Packer()
    out: list[list] = [[] for _ in RESULT]
    for p in partial.to_pylist():
        seq = packer.unpack(p["seq"])[-1]
        count = np.zeros(int(seq.max()) + 1 if len(seq) else 0)
        for data, n in zip(found["data"].to_pylist(), found["n"].to_pylist(), strict=True):
            own, low, high = packer.unpack(data, n, n)
            count[own] = low + (high << 32)
        row, n_rows = np.repeat(np.arange(len(p["docs"])), p["rare"]), len(p["docs"])
        log = np.bincount(row, np.log10(count + 0.5)[seq], n_rows)
        known = np.array(p["known"]) + np.bincount(row, count[seq] > 0, n_rows).astype(np.int64)
        for x, v in zip(out, (p["docs"], p["held"], p["tokens"], known.tolist(), (np.array(p["base"]) + log).tolist(), (np.array(p["score"]) + log).tolist()), strict=True):
            x += v
    return pa.Table.from_batches([_batch(out, RESULT)], RESULT)


def word_table(counts: DataFrame, vocabulary: int = VOCABULARY) -> Table:
    """counts (word, c) of training rows, a stored frame, to the broadcast table."""
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = (counts.filter("octet_length(word) = 0").select("c").first() or [0])[0]
    words = counts.filter("octet_length(word) > 0")
    top = top_words(words.filter(F.octet_length("word") <= LONGEST), vocabulary)
    rest = np.zeros((SPELLING, 2))
    for cls, n, v in words.groupBy((F.crc32(F.substring("word", -2, 2)) % SPELLING).cast("int").alias("class")).agg(F.sum("c"), F.count("*")).collect():
        rest[cls] = n, v
    for w, c in top:
        rest[spelling_class(w) - 1 - SINGLE] -= c, 1
    return Table(top, rest, int(tokens), types, ends)


def lm_parts(docs: DataFrame, *, held_out: str = HELD_OUT, rounds: int = ROUNDS, inner_rounds: int = INNER_ROUNDS, vocabulary: int = VOCABULARY, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame, Table, LogBilinear, InClass]:
    """What scoring needs: counts of words, the numbered texts, the vocabulary, and the two trained models."""
    context = docs.sparkSession.sparkContext
    rows = text_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(held_out).alias("held"), F.col("text").cast("string").alias("text")))
    counts = stored(rows.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    table = word_table(counts, vocabulary)
    shared = context.broadcast(table)
    numbered = stored(rows.mapInArrow(functools.partial(_number, table=shared, limit=chunk_bytes), sql(NUMBERED)), "numbered")
    shards = stored(numbered.select("held", "sizes", "seq", "rare", "n_rare").mapInArrow(functools.partial(_counts, table=shared, each=4), sql(SHARDS)), "shards")
    models = train(shards, table, rounds, inner_rounds)
    discard(shards)
    return counts, numbered, table, *models


def lm_scores(docs: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, text) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; rows where held_out holds are not learned from."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    counts, numbered, table, model, within = lm_parts(docs, **options)
    shared, scorer = context.broadcast(table), context.broadcast((*model.products(), model.b, model.log_normalisers(), within, within.log_normalisers(table.first)))
    buckets = max(1024, 16 * partitions(spark))
    rare = numbered.select("chunk", "rare", "n_rare").mapInArrow(functools.partial(_rare, buckets=buckets), sql(RARE))
    # ties with the vocabulary's rarest word may be in it or not: a count too many does no harm
    least = int(round(10 ** table.logs[-1] - 0.5)) if len(table.logs) else 0
    looked = counts.filter((F.octet_length("word") > 0) & ((F.col("c") <= least) | (F.octet_length("word") > LONGEST))).select((F.crc32("word") % buckets).cast("int").alias("bucket"), "word", "c")
    found = rare.groupBy("bucket").cogroup(looked.groupBy("bucket")).applyInArrow(_look_up, sql(FOUND))
    partial = numbered.mapInArrow(functools.partial(_partial, table=shared, model=scorer), sql(PARTIAL))
    out = partial.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_finish, sql(RESULT))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(table.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

