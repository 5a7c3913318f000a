"""Quality classifier by co-training of two views.

The text view sees a document's bytes and words; the metadata view its language and source, alone and together, and its lengths: of
the text, its words and its lines. Both are logistic models, first fitted in numpy on a bounded sample of labelled rows.
Then all other documents take part, whose features are computed once and stored in shards. In each round every shard
is scored by both views; the rows that a view is sure of, by its calibration on held-back labelled rows, are handed with
their pseudo-labels to the other view, which is fitted further on them and the labelled rows, from the same weights in every shard; the
means of the shards' weights, by rows handed over, are the next round's. A view that knows nothing hands over nothing. At last
the calibrated views are combined, and every document is scored. There are two targets, quality and toxicity; a
document is kept if it is more likely good than not, and more likely harmless than not.

The labelled rows part in three: to fit the views, to calibrate them, and to combine them. SAMPLE_LABELLED bounds them, and
so what reaches the driver (some 20 MB, as Arrow); it is taken by a hash of the id, at a rate that the table's count gives.
The driver holds the labelled rows' features in small types and makes a view's matrix only while it fits or scores it.

Defined results: null and empty texts are scored as empty; null metadata is a value of its own; labels that are null
or of no known document are left out; where there are fewer than five labels of either kind to learn from, every document's score is
the share of good ones (1 without labels); rows that repeat get equal scores; an empty table gives an empty table;
other columns pass through score_documents() untouched.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read_table, stored, text_rows

SAMPLE_LABELLED = 8_000
#: Words are hashed to so many buckets; those that tell most of a target, up to so many, are features.
WORD_BUCKETS, WORD_FEATURES, LEAST_DOCUMENTS = 1 << 18, 384, 8
#: Rounds of exchange; how sure a view must be of a row that it hands over; steps of a shard's fit; documents of a shard.
ROUNDS, SURE, SHARD_STEPS, SHARD = 2, 0.97, 40, 16_384
#: Buckets of a metadata feature, and how many features there are.
META, META_FEATURES = 64, 10
TARGETS = ("quality", "harmless")
WORDS = re.compile(rb"[a-z\x80-\xff]+")


class Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = at = xxhash.xxh32_intdigest(word) % WORD_BUCKETS
        return at


def shape(raw: bytes, words: list[bytes]) -> np.ndarray:
    """What the text looks like: how frequent each ASCII byte is, and how words repeat. About 0 to 5 each."""
    out = np.zeros(136, np.float32)
    if raw:
        count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        letters = count[65:91].sum() + count[97:123].sum()
        out[:128] = np.log1p(100 * count[:128] / len(raw))
        out[128] = 4 * count[65:91].sum() / max(1, letters)
    if words:
        n = len(words)
        out[129] = 4 * sum(map(bytes.__eq__, words, words[1:])) / n
        out[130] = 4 * np.log1p(len(set(words))) / np.log1p(n)
        out[131] = np.log1p(n) / 3
        out[132] = np.log1p(len(raw) / n)
    return out


def text_features(raw: bytes | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """(shape, buckets of distinct words) of a whole text."""
    raw = raw or b""
    found = set(WORDS.findall(raw.lower()))
    return shape(raw, raw.split()), np.fromiter(map(buckets.__getitem__, found), np.int32, len(found))


def octave(x: float) -> int:
    """A length's place among its feature's buckets, two for each doubling."""
    return min(META - 2, int(2 * np.log2(1 + max(0, x))))


def meta_features(lang: str | None, source: str | None, n_chars: int | None, raw: bytes | None) -> list[int]:
    """Places of the metadata's features in META_FEATURES * META."""
    at = lambda x: xxhash.xxh32_intdigest(str(x)) % META
    lines, words = (raw or b"").split(b"\n"), (raw or b"").split()
    longest, n = max(map(len, lines)), sum(map(len, lines))
    lengths = [META - 1 if n_chars is None else octave(n_chars), octave(n), octave(len(words)), octave(len(lines)), octave(longest), octave(n / len(lines)), min(META - 2, 4 * n // max(1, len(words)))]
    return [k * META + x for k, x in enumerate([at(lang), at(source), at((lang, source)), *lengths])]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, decay: float = 1e-4, steps: int = 250) -> np.ndarray:
    """Logistic regression by Adam over all rows, the classes weighed alike. Weights, the last for the bias."""
    w, rate = (np.zeros(x.shape[1] + 1, np.float32), 0.1) if start is None else (start.astype(np.float32), 0.02)
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum())).astype(np.float32)
    m, v, y = np.zeros_like(w), np.zeros_like(w), y.astype(np.float32)
    for t in range(1, steps + 1):
        e = weight * (sigmoid(x @ w[:-1] + w[-1]) - y).astype(np.float32)
        g = np.append(x.T @ e + decay * w[:-1], e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Calibration: weights of the columns of z, and a bias, so that sigmoid gives probabilities. Newton's method."""
    z = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = sigmoid(z @ w)
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), z.T @ (y - p) - 1e-2 * w)
    return w


def telling_words(words: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets whose share of documents differs most between the classes, in standard errors."""
    good = y > 0.5
    a, b = (np.bincount(np.concatenate([np.zeros(0, np.int32), *(np.unique(w) for w, g in zip(words, good, strict=True) if g == side)]), minlength=WORD_BUCKETS) for side in (True, False))
    n, m = good.sum(), (~good).sum()
    share = (a + b) / (n + m)
    z = np.abs(a / n - b / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m) + 1e-12)
    z[(a + b) < LEAST_DOCUMENTS] = 0
    best = np.argsort(-z, kind="stable")[:WORD_FEATURES]
    return np.sort(best[z[best] > 3.5])


def text_matrix(shapes: np.ndarray, hits: np.ndarray) -> np.ndarray:
    return np.concatenate([shapes, hits], axis=1).astype(np.float32)


def word_hits(words: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """Which of the known buckets each document has."""
    out = np.zeros((len(words), len(known)), bool)
    for row, own in enumerate(words):
        at = np.searchsorted(known, own)
        hit = known[np.minimum(at, max(0, len(known) - 1))] == own if len(known) else np.zeros(len(own), bool)
        out[row, at[hit]] = True
    return out


def meta_matrix(places: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), META_FEATURES * META), np.float32)
    out[np.arange(len(places))[:, None], places] = 1
    return out


class Target:
    """One target's views while they are trained: the labelled rows in their three parts, weights, and calibrations."""

    def __init__(self, shapes: np.ndarray, words: list[np.ndarray], places: np.ndarray, y: np.ndarray) -> None:
        part = parts(y)
        self.train, self.even, self.blend = (np.flatnonzero(np.isin(part, x)) for x in ((0, 1, 2), (3,), (4,)))
        self.y, self.known = y, telling_words([words[k] for k in self.train], y[self.train])
        self.shapes, self.hits, self.places = shapes, word_hits(words, self.known), places
        self.weights = [fit(self.view(k, self.train), y[self.train]) for k in (0, 1)]
        self.handed: list[list[list[int]]] = []
        self.calibrate()

    def view(self, k: int, rows: np.ndarray) -> np.ndarray:
        return meta_matrix(self.places[rows]) if k else text_matrix(self.shapes[rows], self.hits[rows])

    def calibrate(self) -> None:
        self.curves = [platt(logits(self.view(k, self.even), w)[:, None], self.y[self.even]) for k, w in enumerate(self.weights)]

    def state(self) -> dict:
        """What a round's tasks need: weights, calibrations, and the rows to fit to, some 350 bytes each."""
        seen = (self.shapes[self.train].astype(np.float16), np.packbits(self.hits[self.train], axis=1), self.places[self.train])
        return {"known": self.known, "weights": self.weights, "curves": self.curves, "seen": seen, "y": self.y[self.train].astype(np.float32)}

    def model(self) -> dict:
        z = np.column_stack([logits(self.view(k, self.blend), w) * c[0] + c[1] for k, (w, c) in enumerate(zip(self.weights, self.curves, strict=True))])
        return {"known": self.known, "weights": self.weights, "curves": self.curves, "mix": platt(z, self.y[self.blend]), "handed": self.handed}


def seen_view(state: dict, k: int) -> np.ndarray:
    """A view's matrix of the rows that a target's state holds."""
    shapes, hits, places = state["seen"]
    if k:
        return meta_matrix(places)
    known = len(state["known"])
    return text_matrix(shapes.astype(np.float32), np.unpackbits(hits, axis=1, count=known) if known else np.zeros((len(shapes), 0)))


def parts(y: np.ndarray) -> np.ndarray:
    """Fifths of the labelled rows, of good and bad ones alike: 0 to 2 to fit, 3 to calibrate, 4 to combine."""
    out = np.zeros(len(y), np.int64)
    for side in (y > 0.5, y <= 0.5):
        out[side] = np.arange(side.sum()) % 5
    return out


def trainable(y: np.ndarray) -> bool:
    return all((side.sum() >= 5) for side in (y > 0.5, y <= 0.5))


def teach(x: np.ndarray, sure: np.ndarray, label: np.ndarray, seen: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """A view fitted further on a shard's rows that the other view is sure of, and how many of either label there are."""
    if not sure.any():
        return weights * 0, [0, 0]
    y = np.concatenate([seen[1], label[sure]])
    return fit(np.concatenate([seen[0], x[sure]]), y, weights, steps=SHARD_STEPS), [int((~label[sure].astype(bool)).sum()), int(label[sure].sum())]


def _pool(batches: Iterable[pa.RecordBatch], known: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (text, lang, source, n_chars) to shards of features, compressed."""
    press = zstandard.ZstdCompressor(level=1).compress
    for shard in shards(batches, SHARD):
        shapes, words, places = zip(*shard, strict=True)
        hits = [np.packbits(word_hits(list(words), k), axis=1).tobytes() for k in known]
        data = np.stack(shapes).astype(np.float16).tobytes() + np.array(places, np.int16).tobytes() + b"".join(hits)
        yield pa.RecordBatch.from_arrays([pa.array([len(shapes)], pa.int64()), pa.array([press(data)], pa.binary())], names=["n", "data"])


def shards(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    buckets, held = Buckets(), []
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            raws, *rest = (c.to_pylist() for c in (batch.column(0).slice(at, 512).cast(pa.binary()), *(batch.column(k).slice(at, 512) for k in (1, 2, 3))))
            for raw, lang, source, n_chars in zip(raws, *rest, strict=True):
                held.append((*text_features(raw, buckets), meta_features(lang, source, n_chars, raw)))
            if len(held) >= size:
                yield held
                held = []
    if held:
        yield held


def unpacked(n: int, data: bytes, known: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """A shard's text matrix for each target, and its metadata matrix."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes = [n * 136 * 2, n * META_FEATURES * 2, *(n * (-(-len(k) // 8)) for k in known)]
    shape, places, *hits = np.split(raw, np.cumsum(sizes)[:-1])
    shape = shape.view(np.float16).reshape(n, 136).astype(np.float32)
    return [text_matrix(shape, np.unpackbits(h.reshape(n, -1), axis=1, count=len(k)) if len(k) else np.zeros((n, 0))) for h, k in zip(hits, known, strict=True)], meta_matrix(places.view(np.int16).reshape(n, META_FEATURES))


def _exchange(batches: Iterable[pa.RecordBatch], state: Broadcast) -> Iterator[pa.RecordBatch]:
    """Shards to what each view learns from the other there: for each target and view the rows handed over by label, and weights times rows."""
    part, targets = TaskContext.get().partitionId(), state.value
    total, counts = [[np.zeros(len(w)) for w in t["weights"]] for t in targets], np.zeros((len(targets), 2, 2), np.int64)
    for batch in batches:
        for n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            texts, meta = unpacked(n, data, [t["known"] for t in targets])
            for k, t in enumerate(targets):
                views = (texts[k], meta)
                p = [sigmoid(logits(x, w) * c[0] + c[1]) for x, w, c in zip(views, t["weights"], t["curves"], strict=True)]
                for own, other in ((0, 1), (1, 0)):
                    w, handed = teach(views[other], (p[own] >= SURE) | (p[own] <= 1 - SURE), (p[own] > 0.5).astype(np.float32), (seen_view(t, other), t["y"]), t["weights"][other])
                    total[k][other] += sum(handed) * w
                    counts[k, other] += handed
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary()), pa.array([np.concatenate([w for t in total for w in t]).tobytes()], pa.binary())], names=["part", "counts", "total"])


def _sum(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = total = part = None
    for batch in batches:
        for k, c, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            c, t = np.frombuffer(c, np.int64), np.frombuffer(t)
            part, counts, total = (k, c, t) if part is None else (part, counts + c, total + t)
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts", "total"])


def co_train(targets: list[Target], pool: DataFrame, rounds: int) -> None:
    """Rounds of exchange over the stored shards. Partial sums are added in order of their tasks; 16 rows reach the driver."""
    context, columns = pool.sparkSession.sparkContext, "part int, counts binary, total binary"
    for _ in range(rounds):
        state = context.broadcast([t.state() for t in targets])
        learnt = pool.mapInArrow(functools.partial(_exchange, state=state), columns)
        rows = sorted(learnt.repartition(16, "part").sortWithinPartitions("part").mapInArrow(_sum, columns).collect())
        state.destroy()  # the driver's copies go too
        if not rows:
            return
        counts = sum(np.frombuffer(r["counts"], np.int64) for r in rows).reshape(len(targets), 2, 2)
        total = np.split(sum(np.frombuffer(r["total"]) for r in rows), np.cumsum([len(w) for t in targets for w in t.weights])[:-1])
        for k, t in enumerate(targets):
            for view in (0, 1):
                if n := counts[k, view].sum():
                    t.weights[view] = (total[2 * k + view] / n).astype(np.float32)
            t.handed.append(counts[k].tolist())
            t.calibrate()


def _places(text: list, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> list[list[int]]:
    return [meta_features(*x) for x in zip(lang.to_pylist(), source.to_pylist(), n_chars.to_pylist(), text, strict=True)]


def _features(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
    buckets, shapes, words, raws = Buckets(), [], [], text.cast(pa.binary()).to_pylist()
    for raw in raws:
        s, w = text_features(raw, buckets)
        shapes.append(s)
        words.append(w)
    return pa.StructArray.from_arrays([pa.array(shapes, pa.list_(pa.float32())), pa.array(words, pa.list_(pa.int32())), pa.array(_places(raws, lang, source, n_chars), pa.list_(pa.int32()))], names=["shape", "words", "meta"])


def _values(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists, none null: all their values, and where each list begins and ends."""
    ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *(np.diff(c.offsets.to_numpy()) for c in column.chunks)]))
    return np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in column.chunks)], dtype=column.type.value_type.to_pandas_dtype()), ends


def labelled_rows(sample: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, dict[str, np.ndarray]]:
    """(shapes, words, places, labels by target, NaN where there are none) of a sample, in an order by the ids' hashes."""
    flat, ends = _values(sample["words"])
    words, ids = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)], sample["chosen_id"].to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (xxhash.xxh64_intdigest(str(ids[k])), ids[k], words[k].tobytes()))
    shapes, places = _values(sample["shape"])[0].reshape(-1, 136), _values(sample["meta"])[0].astype(np.int16).reshape(-1, META_FEATURES)
    return shapes[order], [words[k] for k in order], places[order], {t: sample[t].to_numpy().astype(np.float64)[order] for t in TARGETS}


def _view_columns(docs: DataFrame) -> list[Column]:
    return [F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars")]


def fit_quality(docs: DataFrame, labels: DataFrame, *, labelled: int = SAMPLE_LABELLED, rounds: int = ROUNDS) -> dict:
    """The model: for each target the views' weights and calibrations, their combination and what was handed over, or a constant score."""
    docs = text_rows(docs.select(F.col("doc_id").cast("long").alias("chosen_id"), *_view_columns(docs)))
    uniform = (F.xxhash64(F.lit("sample"), "doc_id").cast("double") + 2.0**63) / 2.0**64
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"), (1 - F.col("toxic").cast("double")).alias("harmless")).filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR harmless IS NOT NULL)")
    some = given.filter(uniform < labelled / max(1, given.count())).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("harmless").alias("harmless"))
    # the sampling rate bounds it: about 8,000 rows of three numbers
    chosen = F.broadcast(some.withColumnRenamed("doc_id", "chosen_id"))
    features = F.arrow_udf(_features, "struct<shape:array<float>, words:array<int>, meta:array<int>>")("text", "lang", "source", "n_chars")
    sample = docs.join(chosen, "chosen_id").select("chosen_id", "quality", "harmless", features.alias("f")).select("chosen_id", "quality", "harmless", "f.*").toArrow()
    shapes, words, places, given_labels = labelled_rows(sample)
    out, targets = {}, {}
    for target in TARGETS:
        own = np.flatnonzero(~np.isnan(given_labels[target]))
        y = given_labels[target][own]
        if trainable(y):
            targets[target] = Target(shapes[own], [words[k] for k in own], places[own], y)
        else:
            out[target] = {"constant": float(y.mean()) if len(y) else 1.0}
    del sample, shapes, words, places
    if targets and rounds:
        free = docs.join(chosen.select("chosen_id"), "chosen_id", "left_anti").select("text", "lang", "source", "n_chars")
        pool = stored(free.mapInArrow(functools.partial(_pool, known=[t.known for t in targets.values()]), "n long, data binary"), "quality-pool")
        co_train(list(targets.values()), pool, rounds)
        discard(pool)
    return out | {name: t.model() for name, t in targets.items()}


def target_scores(model: dict, shapes: np.ndarray, words: list[np.ndarray], meta: list[list[int]]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(shapes), model["constant"])
    (text_w, meta_w), (text_c, meta_c) = model["weights"], model["curves"]
    per_word = np.zeros(WORD_BUCKETS, np.float32)
    per_word[model["known"]] = text_w[136:-1]
    told = np.zeros(WORD_BUCKETS, bool)
    told[model["known"]] = True
    of_words = np.array([per_word[np.unique(w[told[w]])].sum() for w in words], np.float64)
    z_text = (shapes @ text_w[:136] + of_words + text_w[-1]) * text_c[0] + text_c[1]
    z_meta = (meta_w[np.array(meta, np.int64).reshape(-1, META_FEATURES)].sum(axis=1) + meta_w[-1]) * meta_c[0] + meta_c[1]
    return sigmoid(np.column_stack([z_text, z_meta, np.ones(len(z_text))]) @ model["mix"])


def _scorer(model: Broadcast) -> Callable:
    def scores(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        return score_batch(model.value, text, lang, source, n_chars)

    return scores


def score_batch(model: dict, text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
    buckets, found = Buckets(), {"quality": [], "harmless": []}
    for at in range(0, len(text), 512):
        raws = text.slice(at, 512).cast(pa.binary()).to_pylist()
        own = [text_features(raw, buckets) for raw in raws]
        meta = _places(raws, *(x.slice(at, 512) for x in (lang, source, n_chars)))
        shapes = np.stack([s for s, _ in own]).astype(np.float64)
        for target, out in found.items():
            out.append(target_scores(model[target], shapes, [w for _, w in own], meta))
    quality, harmless = (np.concatenate(found[t]) if found[t] else np.zeros(0) for t in ("quality", "harmless"))
    return pa.StructArray.from_arrays([pa.array(quality), pa.array(1 - harmless), pa.array((quality >= 0.5) & (harmless >= 0.5))], names=["quality", "toxicity", "kept"])


def score_with(docs: DataFrame, model: dict, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return text_rows(docs).withColumn(name, F.arrow_udf(_scorer(shared), "struct<quality:double, toxicity:double, kept:boolean>")(*_view_columns(docs)))


def score_documents(docs: DataFrame, labels: DataFrame, *, name: str = "score", **options) -> DataFrame:
    """docs with a column of this name: struct of quality and toxicity, the probabilities, and kept."""
    return score_with(docs, fit_quality(docs, labels, **options), name)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return score_documents(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "score.quality", "score.toxicity", "score.kept")
