"""N-gram Jaccard join by a MinHash LSH forest.

A document is its set of word shingles (five consecutive words; all of them where there are fewer). Equal sets are one
class. Each class has in each of TREES prefix tries a signature of MAX_DEPTH minima. The tries are kept as sorted
signatures, dealt by range, so that even one group of near copies is spread over tasks: what two neighbours in that order
share is the depth at which their paths part, and the longest prefix that a class shares with anyone is what it shares with a neighbour.

Prefixes are shortened adaptively, for each class until the target recall at the similarity threshold: from the depth
in each trie at which a class still has company, and how many tries that holds for. A partner at the threshold shares
SHALLOW levels in so many tries that a class with company in fewer of them has, but for a chance of (1 - recall) / 2, no partner;
its prefixes are not shortened any further. All others go up to the deepest level at which a pair at
the threshold is missed with a chance of (1 - recall) / 2 at most. There the classes of a node are linked to its smallest; what is
linked is a family, whose members meet once, in blocks, for the exact
intersection of their sets. Families, not pairs, are shuffled: links are counted where they are verified.

Defined results: documents without words (null, empty, spaces only) and rows with a null id link with nothing; words
are taken unchanged; rows that repeat an id count as documents of their own; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, partitions, read_table, stored, text_rows
from .graphs import components, group_starts, in_blocks, roots, whole_groups

SHINGLE = 5
#: Similar from this fraction on: 4/5.
THRESHOLD = (4, 5)
TREES, MAX_DEPTH, TARGET_RECALL = 48, 12, 0.9999
#: Levels that are looked at first; a level down to there has 16 bits of a signature, deeper ones 8.
SHALLOW = 3
#: Bytes of a signature in one trie: the levels, and one that marks those which stand for several classes.
SIGNATURE = 2 * SHALLOW + MAX_DEPTH - SHALLOW + 1
#: Members of a block, and shingles that they have on average at most, together.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Hashes of words that a worker keeps.
REMEMBERED = 150_000
MIX = np.uint64(0x9E3779B97F4A7C15)
PLACES = np.random.default_rng(5150).integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def stop_depth(trees: int = TREES, deepest: int = MAX_DEPTH, threshold: tuple[int, int] = THRESHOLD, recall: float = TARGET_RECALL) -> int:
    """Shortens prefixes from the deepest until a pair at the threshold shares a node in some trie, but for a chance of (1 - recall) / 2."""
    s, depth = threshold[0] / threshold[1], deepest
    while depth > 1 and (1 - s**depth) ** trees > (1 - recall) / 2:
        depth -= 1
    return depth


def least_company(trees: int, depth: int, threshold: tuple[int, int], recall: float) -> int:
    """In how many tries a class shares its first levels with a partner at the threshold, but for a chance of (1 - recall) / 2."""
    p, below, k = (threshold[0] / threshold[1]) ** depth, 0.0, 0
    while (below := below + math.comb(trees, k) * p**k * (1 - p) ** (trees - k)) <= (1 - recall) / 2:
        k += 1
    return k


def width(depth: int) -> int:
    """Bytes of the first levels."""
    return 2 * depth if depth <= SHALLOW else SHALLOW + depth


class WordHashes(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def shingles(raw: bytes | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted set of 64-bit hashes of the text's shingles."""
    words = raw.split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out += h[k : k + n] * PLACES[k]
    return np.unique(mixed(out))


def signatures(shingle: np.ndarray, multipliers: np.ndarray, trees: int) -> np.ndarray:
    """One signature for each trie, as bytes: its minima, level by level."""
    folded, low = (shingle >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(folded), 512):
        part = (folded[at : at + 512, None] * multipliers).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    level = mixed(low.astype(np.uint64) + np.uint64(1)).reshape(trees, MAX_DEPTH)
    out = np.zeros((trees, SIGNATURE), np.uint8)
    out[:, : 2 * SHALLOW] = (level[:, :SHALLOW] >> np.uint64(48)).astype(">u2").view(np.uint8).reshape(trees, -1)
    out[:, 2 * SHALLOW : -1] = level[:, SHALLOW:] >> np.uint64(56)
    return out


def shared_depth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many levels the signatures of two arrays share, row by row."""
    differ = a[:, :-1] != b[:, :-1]
    size = np.where(differ.any(axis=1), differ.argmax(axis=1), SIGNATURE - 1)
    return np.where(size < 2 * SHALLOW, size // 2, size - SHALLOW)


def node_keys(tree: np.ndarray, signature: np.ndarray, depth: int) -> np.ndarray:
    """The trie's node at this depth, hashed."""
    wide = np.zeros((len(signature), 16), np.uint8)
    wide[:, : width(depth)] = signature[:, : width(depth)]
    part = wide.view("<u8").reshape(-1, 2)
    return mixed(mixed(part[:, 0] * PLACES[0] + tree.astype(np.uint64) * MIX) + part[:, 1] * PLACES[1]).view(np.int64)


@functools.lru_cache(4)
def multipliers(trees: int, depth: int) -> np.ndarray:
    return np.random.default_rng(8086).integers(0, 2**32, trees * depth, np.uint32) | np.uint32(1)


def _sign(batches: Iterable[pa.RecordBatch], trees: int, size: int) -> Iterator[pa.RecordBatch]:
    hashes, by = WordHashes(), multipliers(trees, MAX_DEPTH)
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part, digests, sizes, signed = batch.slice(at, 1024), [], [], []
            for raw in part.column(1).cast(pa.binary()).to_pylist():
                own = shingles(raw, hashes, size)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                sizes.append(len(own))
                signed.append(signatures(own, by, trees).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signed, pa.binary())], names=["doc_id", "digest", "size", "signatures"])


LEAVES = ["tree", "signature", "rep"]
COMPANY = pa.schema([("rep", pa.int64()), ("key", pa.int64()), ("part", pa.int32()), ("edge", pa.int32()), ("tree", pa.int32()), ("signature", pa.binary()), ("depth", pa.int32())])


def _leaves(batches: Iterable[pa.RecordBatch], trees: int, stop: int) -> Iterator[pa.RecordBatch]:
    """(rep, signatures) to the leaves of the tries: (tree, signature, rep).

    Classes of a batch with one signature are one leaf; for the others their node is known already: as rows of trie
    number `trees`, which sorts after all others, they have (rep, node) for a signature.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            rep, packed = batch.column(0).slice(at, 4096).to_numpy(), fixed(batch.column(1).slice(at, 4096), trees * SIGNATURE)
            by = np.argsort(rep, kind="stable")
            rep, signature = np.repeat(rep[by], trees), packed[by].reshape(-1, SIGNATURE).copy()
            tree = np.tile(np.arange(trees, dtype=np.int32), len(by))
            whole = np.concatenate([tree.astype(">u2").view(np.uint8).reshape(-1, 2), signature], axis=1).view(f"S{SIGNATURE + 2}").ravel()
            order = np.argsort(whole, kind="stable")
            new = np.append(True, whole[order][1:] != whole[order][:-1])
            first, twins = order[new], order[~new]
            signature[first, -1] = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
            known = np.concatenate([rep[twins].astype(">i8").view(np.uint8).reshape(-1, 8), node_keys(tree[twins], signature[twins], stop).view(np.uint8).reshape(-1, 8)], axis=1)
            columns = [np.append(tree[first], np.full(len(twins), trees, np.int32)), np.concatenate([signature[first], known]), np.append(rep[first], rep[twins])]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), binaries(columns[1]), pa.array(columns[2])], names=LEAVES)


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """Binaries of one width as rows of bytes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def binaries(rows: np.ndarray) -> pa.Array:
    offsets = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _walk(batches: Iterable[pa.RecordBatch], trees: int, shallow: int, stop: int) -> Iterator[pa.RecordBatch]:
    """Sorted leaves to those that share `shallow` levels with others, with their node at depth `stop` if they share that.

    The first and the last leaf of the partition come as edges, with what they share so far: their other neighbours are elsewhere.
    """
    part, held = TaskContext.get().partitionId(), None

    def rows(rep: np.ndarray, key: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        n = len(rep)
        null = [pa.nulls(n, f.type) for f in list(COMPANY)[4:]]
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(key, mask=~known), pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, np.int32)), *null], schema=COMPANY)

    def edge(kind: int, tree: int, signature: np.ndarray, rep: int, depth: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"rep": rep, "part": part, "edge": kind, "tree": tree, "signature": signature.tobytes(), "depth": depth}], schema=COMPANY)

    for batch in batches:
        if not batch.num_rows:
            continue
        tree, signature, rep = batch.column(0).to_numpy(), fixed(batch.column(1), SIGNATURE), batch.column(2).to_numpy()
        n = int(np.searchsorted(tree, trees))
        if n < len(tree):
            yield rows(rep[n:], np.ascontiguousarray(signature[n:, 8:]).view("<i8").ravel(), np.ones(len(tree) - n, bool))
        if not n:
            continue
        tree, signature, rep, before = tree[:n], signature[:n], rep[:n], 0
        if held:
            tree, signature, rep, before = np.append(held[0], tree), np.concatenate([held[1][None], signature]), np.append(held[2], rep), held[3]
        start = held is None or held[4] == 3
        deep = np.where(tree[1:] == tree[:-1], shared_depth(signature[1:], signature[:-1]), 0)
        depth = np.maximum(np.append(before, deep), np.append(deep, 0))
        depth = np.where(signature[:, -1] == 1, MAX_DEPTH, depth)
        some = depth >= shallow
        some[-1] = False
        if start and len(tree) > 1:
            some[0] = False
            yield edge(1, int(tree[0]), signature[0], int(rep[0]), int(depth[0]))
        if some.any():
            yield rows(rep[some], node_keys(tree[some], signature[some], stop), depth[some] >= stop)
        held = (int(tree[-1]), signature[-1], int(rep[-1]), int(depth[-1]), 3 if start and len(tree) == 1 else 2)
    if held:
        yield edge(held[4], held[0], held[1], held[2], held[3])


def settled_edges(edges: list, shallow: int, stop: int) -> list[tuple[int, int | None]]:
    """(rep, node) of the partitions' first and last leaves, once each has been held against its neighbour in another partition."""
    edges = sorted(edges, key=lambda r: (r["part"], r["edge"]))
    depth = [r["depth"] for r in edges]
    bytes_of = lambda r: np.frombuffer(bytes(r["signature"]), np.uint8)[None]
    for k, (p, q) in enumerate(zip(edges, edges[1:], strict=False)):
        if p["part"] != q["part"] and p["tree"] == q["tree"]:
            both = int(shared_depth(bytes_of(p), bytes_of(q))[0])
            depth[k], depth[k + 1] = max(depth[k], both), max(depth[k + 1], both)
    key = lambda r: int(node_keys(np.array([r["tree"]]), bytes_of(r), stop)[0])
    return [(r["rep"], key(r) if d >= stop else None) for r, d in zip(edges, depth, strict=True) if d >= shallow]


def candidates(standing: DataFrame, trees: int, threshold: tuple[int, int], recall: float) -> DataFrame:
    """Classes (rep, signatures) to links (a, b) that connect the classes of each node, where prefixes were shortened enough."""
    spark, stop = standing.sparkSession, stop_depth(trees, MAX_DEPTH, threshold, recall)
    shallow = min(SHALLOW, stop)
    leaves = stored(standing.mapInArrow(functools.partial(_leaves, trees=trees, stop=stop), "tree int, signature binary, rep long"), "leaves")
    tries = leaves.repartitionByRange(partitions(spark), "tree", "signature").sortWithinPartitions("tree", "signature")
    company = stored(tries.mapInArrow(functools.partial(_walk, trees=trees, shallow=shallow, stop=stop), "rep long, key long, part int, edge int, tree int, signature binary, depth int"), "company")
    # two rows a partition
    edges = spark.createDataFrame(settled_edges(company.filter("edge > 0").collect(), shallow, stop), "rep long, key long")
    shares = company.filter("edge = 0").select("rep", "key").unionByName(edges)
    going_on = shares.groupBy("rep").agg(F.count("*").alias("tries")).filter(F.col("tries") >= least_company(trees, shallow, threshold, recall)).select("rep")
    nodes = stored(shares.filter("key IS NOT NULL").join(going_on, "rep"), "nodes")
    discard(leaves, company)
    lowest = nodes.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("key", "low")
    # a class is linked to the smallest of its nodes' smallest, and those to it: as well connected, and most of them are the same for all of a group
    met = nodes.join(lowest, "key").groupBy("rep").agg(F.min("low").alias("b"), F.collect_set("low").alias("lows"))
    each = met.select(F.col("rep").alias("a"), "b").unionByName(met.select(F.explode("lows").alias("a"), "b"))
    return each.filter("a <> b").distinct()


def _shingled(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(raw, hashes, size).view(np.int64) for raw in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("copies"), part.column("family"), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "copies", "family", "shingles"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share, as products of slices of the matrix of shared elements."""
    if len(sets) == 2:
        return np.full((2, 2), len(np.intersect1d(*sets, assume_unique=True)))
    row, flat = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    row, code = row[shared], np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    row, code, width = row[order], code[order], 4096
    out = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        low, high = np.searchsorted(code, (at, at + width))
        has = np.zeros((len(sets), width), np.float32)
        has[row[low:high], code[low:high] - at] = 1
        out += has @ has.T
    return out


def _verify(batches: Iterable[pa.RecordBatch], threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["family", "i", "j"], 500):
        n, links, all_p, all_q = table.num_rows, np.zeros(table.num_rows, np.int64), [], []
        rep, copies, i, j, own = (table[c].to_numpy() for c in ("rep", "copies", "i", "j", "own"))
        lists = table["shingles"].combine_chunks()
        bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        starts = group_starts(table, ["family", "i", "j"])
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
            sets = [values[bounds[k] : bounds[k + 1]] for k in range(begin, end)]
            if len(sets) < 2:
                continue
            sizes, both = np.array([len(x) for x in sets]), intersections(sets)
            close = np.triu(both * (threshold[0] + threshold[1]) >= threshold[0] * (sizes[:, None] + sizes[None, :]), 1)
            if i[begin] != j[begin]:
                close &= own[begin:end][:, None] != own[begin:end][None, :]
            p, q = np.nonzero(close)
            links[begin:end] += np.bincount(p, copies[begin:end][q], end - begin).astype(np.int64) + np.bincount(q, copies[begin:end][p], end - begin).astype(np.int64)
            all_p.append(p + begin)
            all_q.append(q + begin)
        p, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (all_p, all_q))
        low, used = roots(n, p, q), np.unique(np.concatenate([p, q]))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(rep[used]), pa.array(links[used]), pa.array(rep[low[used]])], names=["rep", "links", "root"])


def near_documents(docs: DataFrame, *, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, trees: int = TREES, recall: float = TARGET_RECALL) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, n_links, component_id, kept), one for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(text_rows(rows).mapInArrow(functools.partial(_sign, trees=trees, size=shingle), "doc_id long, digest binary, size long, signatures binary"), "signatures")
    usable = F.col("doc_id").isNotNull() & F.col("digest").isNotNull()
    classes = stored(signed.filter(usable).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size")), "classes")
    # one row of each class stands in the tries; a repeated id gives the same signatures twice
    standing = signed.filter(usable).join(classes.select("rep", F.col("digest").alias("of")), (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("of")))
    families = components(candidates(standing.select("rep", "signatures"), trees, threshold, recall)).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    texts = rows.join(families.join(classes, "rep"), F.col("doc_id") == F.col("rep")).select("rep", "copies", "family", "text").dropDuplicates(["rep"])
    sets = stored(texts.mapInArrow(functools.partial(_shingled, size=shingle), "rep long, copies long, family long, shingles array<bigint>"), "shingles")
    met = in_blocks(sets.select("rep", "family", F.size("shingles").alias("weight")), "family", "rep", BLOCK, BLOCK_SHINGLES)
    dealt = met.join(sets.drop("family"), "rep").select("family", "i", "j", "own", "rep", "copies", "shingles").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    found = stored(dealt.mapInArrow(functools.partial(_verify, threshold=threshold), "rep long, links long, root long"), "near")
    discard(sets)
    labels = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(counts, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left")
    known = known.select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = signed.filter(usable).select("doc_id", "digest").join(known, "digest").select("doc_id", "n_links", "component_id")
    alone = signed.filter(~usable).select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
each AS (SELECT doc_id, len(s) AS size, unnest(s) AS s FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.size, b.size HAVING 5 * count(*) >= 4 * (a.size + b.size - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, doc_id = low AS kept FROM documents JOIN low ON low.a = doc_id LEFT JOIN n ON n.a = doc_id
"""
