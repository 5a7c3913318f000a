"""BM25 over an index of segments with blocks of postings: exact top k without scoring every posting, and changes without a rebuild.

A segment is written once. Its chunks are dealt to ranges of at most BLOCK chunks that lie together in the input; a block
holds a term's postings in one range, the largest frequency and the smallest length among them. From these two follows
the most that the term can add to any score in the range, whatever the corpus' statistics have become. A file holds the
blocks of some ranges, sorted by term and range within runs of ranges: postings are grouped where texts are read. The
blocks of a term that stands everywhere lie in many files, and the bounds are read without the postings.

A search hands the terms of its queries, if they are few, to all tasks. Their blocks are dealt by range, and a task scores a
range for the queries whose bound there reaches the k-th best score that it has seen. For more terms there are two passes: the first
scores the ranges with the largest bounds, the k-th best score there is a threshold, and the second scores the ranges whose bound
reaches it. No other chunk can be among the k best, so the result is that of scoring everything, ties included.

A change writes one more segment: the blocks of what was added, and what was removed as a list of chunks (a posting is
dead if a later segment removed its chunk), with what they take from document frequencies and totals. Only added texts are
cut in tokens. merged() puts a run of segments in place of which one remains, dead postings left out; tail_to_merge()
picks the run so that a posting is written a number of times that grows with the logarithm of the corpus.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..schemas import Bm25Config
from .bm25 import MOST_TERMS, SLICE, best_of, contribution, handed, idf, query_terms, top_k

#: Folders of segments are named so, and by a number of their own.
SEGMENT = "segment"
#: A range holds 2 ** BLOCK_BITS chunks at most.
BLOCK_BITS = 7
#: Tokens that a task groups at once, in whole ranges.
SLICE_TOKENS = 1 << 20
#: Removed chunks whose lists every task gets, at most; more of them meet the blocks in a shuffle.
MOST_REMOVED = 200_000
#: Ranges that the first pass scores for each query.
FIRST_RANGES = 8
#: A segment joins those after it in a merge if it has at most so many times their postings.
MERGE_RATIO = 3


@dataclass(frozen=True)
class Segment:
    """Where a segment lies, its postings' number, and the names of the segments that were merged into it (its own if none)."""

    path: str
    postings: int
    covers: tuple[str, ...]


@dataclass(frozen=True)
class SegmentedIndex:
    spark: SparkSession
    segments: tuple[Segment, ...] = ()

    @classmethod
    def open(cls, spark: SparkSession, paths: list[str]) -> SegmentedIndex:
        about = [(p, spark.read.parquet(f"{p}/about").first()) for p in paths]
        return cls(spark, tuple(Segment(p, row["postings"], tuple(row["covers"])) for p, row in about))

    def paths(self) -> list[str]:
        return [s.path for s in self.segments]

    def _all(self, name: str) -> DataFrame:
        """A table of all segments in one scan, with the number of each row's segment."""
        numbers = F.create_map(*(x for k, s in enumerate(self.segments) for x in (F.lit(os.path.basename(s.path)), F.lit(k))))
        rows = self.spark.read.parquet(*(f"{s.path}/{name}" for s in self.segments))
        return rows.withColumn("segment", numbers[F.regexp_extract("_metadata.file_path", f"({SEGMENT}-[0-9a-f]+)/{name}/", 1)])

    def blocks(self) -> DataFrame:
        """(term, range, n, max_tf, min_len, postings, segment). The blocks of the term '' list the chunks of each range."""
        return self._all("blocks")

    def removed(self) -> DataFrame:
        """(home, chunk_id, len, segment): a chunk that a segment removed, and the name of the segment it lay in."""
        return self._all("removed")

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """(term, df) of some terms, from the blocks' counts and what was removed."""
        kept = self.blocks().filter("term <> ''").select("term", F.col("n").alias("df"))
        gone = self._all("removed_terms").select("term", (-F.col("n")).alias("df"))
        return kept.unionByName(gone).join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def statistics(self) -> DataFrame:
        """One row: n, total_len, avgdl."""
        total = self._all("statistics").agg(F.sum("n").alias("n"), F.sum("total_len").alias("total_len"))
        return total.withColumn("avgdl", F.when(F.col("n") > 0, F.col("total_len") / F.col("n")).otherwise(0.0))

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (segment, chunk_id, ...) without those whose chunk a later segment removed."""
        if len(self.segments) < 2:
            return rows
        last = self.removed().groupBy("chunk_id").agg(F.max("segment").alias("by"))
        return rows.join(last, (rows["chunk_id"] == last["chunk_id"]) & (rows["segment"] < last["by"]), "left_anti")

    def chunks(self) -> DataFrame:
        """(segment, chunk_id, len, digest) of the chunks that are in the index."""
        each = self.blocks().filter("term = ''").select("segment", F.explode("postings").alias("p"))
        return self.live(each.select("segment", "p.chunk_id", "p.len", "p.digest"))


def new_segment(under: str) -> str:
    return os.path.join(under, f"{SEGMENT}-{uuid.uuid4().hex}")


def _columns(kind: str) -> str:
    """A block's columns, for chunk ids of a kind."""
    return f"term string, range long, n long, max_tf long, min_len int, postings array<struct<chunk_id: {kind}, tf: long, len: int, digest: string>>"


def _grouped(rows: pa.Table) -> pa.RecordBatch:
    """Whole ranges of rows (chunk_id, digest, range, tokens) to their blocks, sorted by term and range, each with its postings by chunk_id."""
    rows = rows.take(pc.sort_indices(rows, [("range", "ascending"), ("chunk_id", "ascending")])).combine_chunks()
    lists, n = rows["tokens"].combine_chunks(), len(rows)
    length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    tokens = lists.flatten().dictionary_encode()
    terms = pa.concat_arrays([pa.array([""], tokens.dictionary.type), tokens.dictionary])
    order = pc.sort_indices(terms).to_numpy()  # the term '' comes first
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    each = place[1:][tokens.indices.to_numpy(zero_copy_only=False)] * n + np.repeat(np.arange(n), length)
    found, tf = np.unique(each, return_counts=True)
    term, row = np.divmod(np.concatenate([np.arange(n), found]), n)
    tf, span = np.concatenate([np.zeros(n, np.int64), tf]), rows["range"].to_numpy()[row]
    new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (span[1:] != span[:-1])))
    own = pa.array(row)
    digests = pa.concat_arrays([rows["digest"].combine_chunks(), pa.nulls(len(found), rows.schema.field("digest").type)])
    postings = pa.StructArray.from_arrays([rows["chunk_id"].combine_chunks().take(own), pa.array(tf), pa.array(length[row].astype(np.int32)), digests], ["chunk_id", "tf", "len", "digest"])
    blocks = {
        "term": terms.take(pa.array(order[term[new]])), "range": pa.array(span[new]), "n": pa.array(np.diff(np.append(new, len(row)))),
        "max_tf": pa.array(np.maximum.reduceat(tf, new)), "min_len": pa.array(np.minimum.reduceat(length[row], new).astype(np.int32)),
        "postings": pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), postings),
    }
    return pa.RecordBatch.from_arrays(list(blocks.values()), list(blocks))


def _group(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows as _grouped() takes them, of which those of a range follow each other, to blocks: so many tokens at once, and whole ranges."""
    held, size = [], 0
    for whole in batches:
        ends, low = np.cumsum(whole.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), 0
        while low < whole.num_rows:
            before = int(ends[low - 1]) if low else 0
            high = min(max(int(np.searchsorted(ends, before + most, "right")), low + 1), whole.num_rows)
            held.append(pa.Table.from_batches([whole.slice(low, high - low)]))
            size, low = size + int(ends[high - 1]) - before, high
            if size >= most:
                rows = pa.concat_tables(held)
                span = rows["range"].to_numpy()
                cut = int(np.flatnonzero(span != span[-1])[-1]) + 1 if span[0] != span[-1] else 0
                if cut:
                    yield from _parts(_grouped(rows.slice(0, cut)))
                    held = [rows.slice(cut).combine_chunks()]
                    size = int(pc.sum(pc.list_value_length(held[0]["tokens"])).as_py() or 0)
    if held:
        yield from _parts(_grouped(pa.concat_tables(held)))


def _parts(blocks: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """A batch in slices, as a reader holds one at a time."""
    return (blocks.slice(k, rows) for k in range(0, blocks.num_rows, rows))


def _blocks(terms: DataFrame) -> DataFrame:
    """Rows (chunk_id, digest, len, range, term, tf), with a row of the term '' for each chunk, to blocks."""
    posting = F.struct("chunk_id", "tf", "len", F.when(F.col("term") == "", F.col("digest")).alias("digest"))
    return terms.groupBy("term", "range").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.sort_array(F.collect_list(posting)).alias("postings"))


def _write(spark: SparkSession, path: str, blocks: DataFrame, removed: DataFrame, removed_terms: DataFrame, covers: tuple[str, ...] | None = None) -> Segment:
    """blocks in the files' order; removed (home, chunk_id, len) and removed_terms (home, term, n)."""
    blocks.write.parquet(f"{path}/blocks")
    removed.write.parquet(f"{path}/removed")
    removed_terms.write.parquet(f"{path}/removed_terms")
    chunks = spark.read.parquet(f"{path}/blocks").filter("term = ''").select("n", F.aggregate("postings", F.lit(0).cast("long"), lambda a, p: a + p["len"]).alias("total_len"))
    gone = spark.read.parquet(f"{path}/removed").select(F.lit(-1).cast("long").alias("n"), (-F.col("len")).cast("long").alias("total_len"))
    chunks.unionByName(gone).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total_len"), F.lit(0)).alias("total_len")).write.parquet(f"{path}/statistics")
    own = covers or (os.path.basename(path),)
    count = spark.read.parquet(f"{path}/blocks").filter("term <> ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("postings"))
    count.withColumn("covers", F.array(*map(F.lit, own))).coalesce(1).write.parquet(f"{path}/about")
    return Segment(path, spark.read.parquet(f"{path}/about").first()["postings"], own)


def digest_of(text: Column) -> Column:
    """What tells a chunk's text from another."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def add_segment(index: SegmentedIndex, under: str, added: DataFrame, removed: DataFrame | None = None, *, block_bits: int = BLOCK_BITS) -> SegmentedIndex:
    """The index with chunks (chunk_id, text) added and those with the ids in removed (chunk_id) taken out first; a chunk that changed is in both.

    Ids that are not in the index are passed over; chunk ids of `added` must not be in the index or must be in `removed`.
    """
    spark, path = index.spark, new_segment(under)
    # rows that lie together in the input share a range, so a task that reads them makes and groups all its postings: neither texts nor postings are shuffled
    ranges = F.shiftright(F.monotonically_increasing_id(), block_bits).alias("range")
    rows = added.select("chunk_id", digest_of(F.col("text")).alias("digest"), ranges, tokenize(F.col("text")).alias("tokens"))
    kind = added.schema["chunk_id"].dataType.simpleString()
    if removed is None or not index.segments:
        gone, gone_terms = spark.createDataFrame([], f"home string, chunk_id {kind}, len int"), spark.createDataFrame([], "home string, term string, n bigint")
    else:
        names = F.array(*(F.lit(s.covers[-1]) for s in index.segments))
        wanted = removed.select("chunk_id").distinct()
        homes = index.live(index.blocks().filter("term = ''").select("segment", "range", F.explode("postings").alias("p")).select("segment", "range", "p.chunk_id", "p.len").join(wanted, "chunk_id", "left_semi"))
        gone = homes.select(F.get(names, "segment").alias("home"), "chunk_id", "len")
        # their terms, from the blocks of their ranges, each of which meets the list of its range; few lists are handed out
        lists = homes.groupBy("segment", "range").agg(F.collect_set("chunk_id").alias("gone"))  # a range's chunks at most
        lists = F.broadcast(lists) if homes.limit(MOST_REMOVED + 1).count() <= MOST_REMOVED else lists
        met = index.blocks().filter("term <> ''").join(lists, ["segment", "range"])
        counts = met.select("segment", "term", F.size(F.filter("postings", lambda p: F.array_contains(F.col("gone"), p["chunk_id"]))).cast("long").alias("n")).filter("n > 0")
        gone_terms = counts.groupBy("segment", "term").agg(F.sum("n").alias("n")).select(F.get(names, "segment").alias("home"), "term", "n")
    blocks = rows.mapInArrow(functools.partial(_group, most=SLICE_TOKENS), _columns(kind))
    return SegmentedIndex(spark, (*index.segments, _write(spark, path, blocks, gone, gone_terms)))


def tail_to_merge(index: SegmentedIndex) -> int:
    """How many of the last segments a merge should join: those that are not much larger than all after them."""
    sizes, n, after = [s.postings for s in index.segments], 1, 0
    while n < len(sizes) and sizes[-n - 1] <= MERGE_RATIO * (after + sizes[-n]):
        after, n = after + sizes[-n], n + 1
    return n


def merged(index: SegmentedIndex, under: str, last: int, *, block_bits: int = BLOCK_BITS) -> SegmentedIndex:
    """The index with its last segments joined in one. What they removed from each other is left out, what they removed from earlier ones stays removed."""
    if last < 2:
        return index
    spark, path, before, group = index.spark, new_segment(under), index.segments[:-last], SegmentedIndex(index.spark, index.segments[-last:])
    covers = tuple(name for s in group.segments for name in s.covers)
    ranges = group.chunks().repartitionByRange("segment", "chunk_id").sortWithinPartitions("segment", "chunk_id")
    ranges.select("segment", "chunk_id", "digest", F.shiftright(F.monotonically_increasing_id(), block_bits).alias("range")).write.parquet(f"{path}/ranges")
    kept = spark.read.parquet(f"{path}/ranges")
    postings = group.blocks().select("segment", "term", F.explode("postings").alias("p")).select("segment", "term", "p.chunk_id", "p.tf", "p.len")
    terms = postings.join(kept, ["segment", "chunk_id"]).select("chunk_id", F.when(F.col("term") == "", F.col("digest")).alias("digest"), "len", "range", "term", "tf")
    outside = ~F.col("home").isin(*covers)
    gone, gone_terms = (group._all(t).filter(outside).drop("segment") for t in ("removed", "removed_terms"))
    return SegmentedIndex(spark, (*before, _write(spark, path, _blocks(terms).sortWithinPartitions("term", "range"), gone, gone_terms, covers)))


def refreshed(index: SegmentedIndex, chunks: DataFrame, under: str, *, block_bits: int = BLOCK_BITS) -> SegmentedIndex:
    """The index of chunks (chunk_id, text) as they are now, from an index of what they were: digests are compared, and only what changed is cut in tokens."""
    if not index.segments:
        return add_segment(index, under, chunks, block_bits=block_bits)
    known = index.chunks().select("chunk_id", "digest").withColumn("known", F.lit(True))
    now = chunks.select("chunk_id", digest_of(F.col("text")).alias("digest"))
    gone = known.join(now, ["chunk_id", "digest"], "left_anti").select("chunk_id")
    new = chunks.withColumn("digest", digest_of(F.col("text"))).join(known.drop("known"), ["chunk_id", "digest"], "left_anti").select("chunk_id", "text")
    if gone.isEmpty() and new.isEmpty():
        return index
    out = add_segment(index, under, new, gone, block_bits=block_bits)
    return merged(out, under, tail_to_merge(out), block_bits=block_bits)


def weighed_terms(index: SegmentedIndex, queries: DataFrame) -> tuple[DataFrame, bool]:
    """(query_id, term, weight, avgdl), a term's idf as often as the query has it, and whether these are few.

    Few rows are fetched once and handed out, so that no step shuffles blocks to meet them or counts frequencies again.
    """
    asked = query_terms(queries)
    few = asked.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    asked = F.broadcast(asked) if few else asked
    terms = asked.join(index.frequencies(asked), "term").crossJoin(F.broadcast(index.statistics()))  # one row of statistics
    weighed = terms.select("query_id", "term", "avgdl", (F.col("qtf") * idf(F.col("n"), F.col("df"))).alias("weight"))
    return (F.broadcast(index.spark.createDataFrame(weighed.collect(), weighed.schema)) if few else weighed), few  # at most MOST_TERMS rows


def range_bounds(index: SegmentedIndex, weighed: DataFrame, config: Bm25Config) -> DataFrame:
    """(query_id, segment, range, bound, n): the most that a chunk of the range can score, and how many postings that would read."""
    most = contribution(F.col("weight"), F.col("max_tf"), F.col("min_len"), F.col("avgdl"), config)
    heads = index.blocks().select("segment", "term", "range", "n", "max_tf", "min_len")
    return heads.join(weighed, "term").groupBy("query_id", "segment", "range").agg(F.sum(most).alias("bound"), F.sum("n").alias("n"))


def _scored(index: SegmentedIndex, weighed: DataFrame, ranges: DataFrame, config: Bm25Config, digits: int | None) -> DataFrame:
    """(query_id, chunk_id, score) of the live chunks in these ranges (query_id, segment, range)."""
    wanted = weighed.join(ranges, "query_id")
    blocks = index.blocks().select("segment", "term", "range", "postings").join(wanted, ["segment", "term", "range"])
    each = blocks.select("query_id", "segment", "weight", "avgdl", F.explode("postings").alias("p")).select("query_id", "segment", "weight", "avgdl", "p.chunk_id", "p.tf", "p.len")
    part = contribution(F.col("weight"), F.col("tf"), F.col("len"), F.col("avgdl"), config)
    scores = index.live(each.groupBy("query_id", "segment", "chunk_id").agg(F.sum(part).alias("score"))).drop("segment")
    return (scores if digits is None else scores.withColumn("score", F.round("score", digits))).filter("score > 0")


def _whole_ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows (segment, range, ...) in their order, in tables of whole ranges."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([*held, batch])
            segment, span = rows["segment"].to_numpy(), rows["range"].to_numpy()
            before = np.flatnonzero((segment != segment[-1]) | (span != span[-1]))
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield rows.slice(0, cut)
            held = rows.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _best_of_ranges(batches: Iterable[pa.RecordBatch], asked: Broadcast, k: int, c: Bm25Config, margin: float) -> Iterator[pa.RecordBatch]:
    """Blocks (segment, range, term, max_tf, min_len, postings) by segment and range to the best chunks of each query: number, chunk_id, score.

    A range is scored for the queries whose bound there reaches the k-th best score so far. The block of no term lists dead chunks.
    """
    terms, begins, numbers, weights, n, avgdl = asked.value
    floor, held, size = np.zeros(n), [], 0

    def gain(f: np.ndarray, length: np.ndarray) -> np.ndarray:
        return f * (c.k1 + 1) / (f + c.k1 * (1 - c.b + c.b * length / max(avgdl, 1e-9)))

    def pairs(term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms, and where in the queries' terms, for each query that has it."""
        each = begins[term + 1] - begins[term]
        return np.repeat(np.arange(len(term)), each), np.arange(int(each.sum())) + np.repeat(begins[term] - np.cumsum(each) + each, each)

    for rows in _whole_ranges(batches):
        rows = rows.combine_chunks()
        place = pc.index_in(rows["term"].combine_chunks(), value_set=terms).fill_null(-1).to_numpy()
        key = [rows[name].to_numpy() for name in ("segment", "range")]
        span = np.cumsum(np.append(False, (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])))
        heads = np.flatnonzero(place >= 0)
        of, at = pairs(place[heads])
        most = weights[at] * gain(*(rows[name].to_numpy(zero_copy_only=False)[heads[of]].astype(np.float64) for name in ("max_tf", "min_len")))
        reached, which = np.unique(span[heads[of]] * n + numbers[at], return_inverse=True)
        reached = reached[np.bincount(which, most, len(reached)) * (1 + 1e-9) + margin >= floor[reached % n]]
        lists = rows["postings"].combine_chunks()
        items, block = lists.flatten(), np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy(zero_copy_only=False))
        chunk = items.field("chunk_id").dictionary_encode()
        row = span[block] * len(chunk.dictionary) + chunk.indices.to_numpy(zero_copy_only=False)
        good = (place[block] >= 0) & ~np.isin(row, row[place[block] < 0])
        order = np.flatnonzero(good)[np.argsort(row[good], kind="stable")]
        row, block = row[order], block[order]
        part = gain(*(items.field(name).to_numpy(zero_copy_only=False)[order].astype(np.float64) for name in ("tf", "len")))
        each = begins[place[block] + 1] - begins[place[block]]
        firsts, low = np.flatnonzero(np.append(row[:1] >= 0, row[1:] != row[:-1])), 0  # of each chunk's postings
        ends = np.concatenate([[0], np.cumsum(np.add.reduceat(each, firsts))]) if len(firsts) else np.zeros(1, np.int64)
        firsts = np.append(firsts, len(row))
        while low < len(firsts) - 1:
            high = min(max(int(np.searchsorted(ends, ends[low] + SLICE, "right")) - 1, low + 1), len(firsts) - 1)
            own = slice(firsts[low], firsts[high])
            of, at = pairs(place[block[own]])
            keep = np.isin(span[block[own]][of] * n + numbers[at], reached)
            of, at = of[keep], at[keep]
            cell, which = np.unique(row[own][of] * n + numbers[at], return_inverse=True)
            score = np.bincount(which, weights[at] * part[own][of], len(cell))
            where, query = np.divmod(cell, n)
            keep = (score > 0) & (score >= floor[query] - margin)
            names = chunk.dictionary.take(pa.array(where[keep] % len(chunk.dictionary)))
            held.append(pa.table([pa.array(query[keep]), names, pa.array(score[keep])], ["number", "chunk_id", "score"]))
            size, low = size + int(keep.sum()), high
            if size > 4 * n * k + SLICE // 16:
                best, some, least = best_of(pa.concat_tables(held).combine_chunks(), k, margin)
                floor[some] = least
                held, size = [best], best.num_rows
    if size:
        yield from best_of(pa.concat_tables(held).combine_chunks(), k, margin)[0].combine_chunks().to_batches()


def _few_searched(index: SegmentedIndex, weighed: DataFrame, k: int, config: Bm25Config, digits: int | None) -> DataFrame:
    """block_search() for a few queries, whose terms every task gets: the blocks of these terms cross one shuffle by range, and each task keeps the best of each query."""
    spark = index.spark
    blocks = index.blocks().select("segment", "range", "term", "max_tf", "min_len", "postings")
    own = blocks.join(F.broadcast(weighed.select("term").distinct()), "term", "left_semi")
    if len(index.segments) > 1:
        last = index.removed().groupBy("chunk_id").agg(F.max("segment").alias("by"))
        each = blocks.filter("term = ''").select("segment", "range", F.explode("postings").alias("p")).withColumn("chunk_id", F.col("p.chunk_id"))
        dead = each.join(last, "chunk_id").filter(F.col("segment") < F.col("by")).groupBy("segment", "range").agg(F.collect_list("p").alias("postings"))  # a range's at most
        own = own.unionByName(dead.withColumn("term", F.lit("")), allowMissingColumns=True)
    dealt = own.select(blocks.columns).repartition("segment", "range").sortWithinPartitions("segment", "range")
    shared, ids = handed(spark, weighed.collect())  # at most MOST_TERMS rows
    kinds = [blocks.schema["postings"].dataType.elementType["chunk_id"].dataType.simpleString(), weighed.schema["query_id"].dataType.simpleString()]
    found = dealt.mapInArrow(functools.partial(_best_of_ranges, asked=shared, k=k, c=config, margin=_slack(digits)), f"number long, chunk_id {kinds[0]}, score double")
    names = spark.createDataFrame(list(enumerate(ids)), f"number long, query_id {kinds[1]}")
    return top_k(found.join(F.broadcast(names), "number").select("query_id", "chunk_id", "score"), k, digits=digits)


def _reaching(bounds: DataFrame, threshold: DataFrame, digits: int | None) -> DataFrame:
    """The ranges whose bound reaches the threshold of their query."""
    return bounds.join(threshold, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") * (1 + 1e-9) + _slack(digits) >= F.col("least")))


def _slack(digits: int | None) -> float:
    """What scores may differ by: sums of the same numbers in another order differ in their last bits, and rounded scores by half a unit."""
    return 1e-9 if digits is None else 10.0**-digits


def passes(index: SegmentedIndex, queries: DataFrame, k: int, config: Bm25Config | None = None, *, digits: int | None = None, first_ranges: int = FIRST_RANGES) -> tuple[DataFrame, DataFrame]:
    """The ranges that the first and the second pass score: (query_id, segment, range, n)."""
    return _passes(index, weighed_terms(index, queries)[0], k, config or Bm25Config(), digits, first_ranges)[:2]


def _passes(index: SegmentedIndex, weighed: DataFrame, k: int, config: Bm25Config, digits: int | None, first_ranges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ranges of both passes and the first pass' scores."""
    bounds = range_bounds(index, weighed, config)
    largest = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "range")
    nth = bounds.withColumn("nth", F.row_number().over(largest))
    first = nth.filter(F.col("nth") <= first_ranges)
    scored = _scored(index, weighed, first.select("query_id", "segment", "range"), config, digits)
    threshold = top_k(scored, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = bounds.join(first.select("query_id", "segment", "range"), ["query_id", "segment", "range"], "left_anti")
    second = _reaching(rest, threshold, digits)
    return first.select("query_id", "segment", "range", "n"), second.select("query_id", "segment", "range", "n"), scored


def block_search(index: SegmentedIndex, queries: DataFrame, k: int, config: Bm25Config | None = None, *, digits: int | None = None, first_ranges: int = FIRST_RANGES) -> DataFrame:
    """queries (query_id, text) to (query_id, chunk_id, score, rank), as bm25_search() gives it."""
    c = config or Bm25Config()
    weighed, few = weighed_terms(index, queries)
    if few and k > 0 and not weighed.isEmpty():
        return _few_searched(index, weighed, k, c, digits)
    _, second, scored = _passes(index, weighed, k, c, digits, first_ranges)
    more = _scored(index, weighed, second.select("query_id", "segment", "range"), c, digits)
    return top_k(scored.unionByName(more), k)
