"""Near-duplicate lines by a join of deletion neighbourhoods, in DataFrame functions only.

The lines of a text are what line feeds part; the words of a line are what single spaces part. A line is removed if an
earlier line (by doc_id, then place in the text) is equal to it or, both having min_words words at least, within one word: one
inserted, deleted or replaced. Lines are judged on the input, not on what is left; blank lines stay.

All variants of a line with up to one word deleted are emitted as hashed keys, first coarsely: a variant's key is the
hash of its length and its first HEAD words, which makes all deletions further back one key, so a line has HEAD + 2
keys whatever its length. Lines share a key if they are within the bound. Where up to SMALL_GROUP different lines share one,
they are compared in pairs. In larger groups every line emits each of its variants in full, hashed by the place of the
deletion, what stands before it and what stands after it, and each group of equal variants yields its earliest line, so
that no group is ever expanded to pairs. Both ways end in the verification of the edit distance on the words themselves.
Equal lines are one class throughout, found by aggregation. Up to BROADCAST_BYTES of keys of shared variants or hashes of their
lines, a size that is counted first, are broadcast; beyond that the same joins shuffle. Removed lines come back to a row by
its id and a hash of its text, so that rows without an id don't all meet under one key.

Defined results: null counts as empty text, which has one blank line; null ids come after all others; equal lines at one place
of rows that repeat an id are earliest together, so both stay; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stored

#: Lines of fewer words than the first are removed only if equal. The bound itself, one word, is what the keys are made for.
MIN_WORDS, HEAD, SMALL_GROUP = 8, 5, 12
#: Bytes of a broadcast table as its rows of numbers stand in memory, some 32 a row and 16 a number.
BROADCAST_BYTES = 32 << 20
LAST = 2**63 - 1


def row_key() -> Column:
    """With the id, what a row's removed lines are known by. Rows that are equal in both lose the same lines."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def text_lines(docs: DataFrame) -> DataFrame:
    """(doc, row, no, line, h1, h2, n): the lines that are not blank, with 128 bits of hash and their number of words."""
    every = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), row_key().alias("row"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "line"))
    every = every.filter(F.ltrim("line", F.lit(" \t\r\v\f")) != "")
    n = (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("int")
    return every.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line"), "n": n})


def coarse_keys() -> Column:
    """Of a line with its `head`, the first HEAD + 1 words: the keys of all its variants."""
    word = [F.get("head", F.lit(k)) for k in range(HEAD + 1)]
    keys = [F.xxhash64(F.col("n"), *word[:HEAD]), F.xxhash64(F.col("n") - 1, *word[:HEAD])]
    keys += [F.xxhash64(F.col("n") - 1, *word[:k], *word[k + 1 :]) for k in range(HEAD)]
    return F.explode(F.array(*keys))


def keyed_lines(lines: DataFrame, min_words: int) -> DataFrame:
    return lines.filter(F.col("n") >= min_words).withColumn("head", F.split("line", " ", HEAD + 2)).select("h1", "h2", coarse_keys().alias("key"))


def if_small(df: DataFrame) -> DataFrame:
    """df, of numbers, to be broadcast if it is small; df must be stored."""
    return F.broadcast(df) if df.count() * (32 + 16 * len(df.columns)) <= BROADCAST_BYTES else df


def full_variants(lines: DataFrame) -> DataFrame:
    """(key, h1, h2): for every word the line without it, and for every place between words the line parted there.

    Lines within one word of each other meet: one's deletion is the other's deletion of the same place, or the other
    parted at it. Keys hash the place, what stands before and what stands after, as running exclusive ors of words hashed with
    their distances from the start and from the end.
    """
    words = lines.select("h1", "h2", "n", F.posexplode(F.concat(F.split("line", " "), F.array(F.lit(None).cast("string")))).alias("at", "word"))
    own = Window.partitionBy("h1", "h2")
    running = own.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    real = F.col("at") < F.col("n")
    words = words.withColumn("front", F.when(real, F.xxhash64("at", "word")).otherwise(0)).withColumn("back", F.when(real, F.xxhash64(F.col("n") - F.col("at"), "word")).otherwise(0))
    words = words.select("h1", "h2", "at", real.alias("real"), F.bit_xor("front").over(running).bitwiseXOR(F.col("front")).alias("before"), F.bit_xor("back").over(own).bitwiseXOR(F.bit_xor("back").over(running)).alias("after"), "back")
    deleted = F.when(F.col("real"), F.xxhash64("at", "before", "after"))
    parted = F.xxhash64("at", "before", F.col("after").bitwiseXOR(F.col("back")))
    return words.select("h1", "h2", F.explode(F.array(deleted, parted)).alias("key")).filter("key IS NOT NULL")


def within_one_word(a: Column, b: Column) -> Column:
    """Whether the edit distance of two arrays of words is at most one: what they share at the front and at the back covers all but one."""
    longest = F.greatest(F.size(a), F.size(b))

    def shared(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
        return F.when(at == 0, longest).otherwise(at - 1)

    return shared(a, b) + shared(F.reverse(a), F.reverse(b)) >= longest - 1


def near_lines(lines: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2, near_doc, near_no): lines with the place of the earliest other line within one word, if it is earlier."""
    keyed = keyed_lines(lines, min_words)
    shared = stored(keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high").select("key"), "line-keys")
    members = stored(keyed.join(if_small(shared), "key").distinct(), "line-members")
    found = stored(members.select("h1", "h2").distinct(), "line-hashes")
    place = F.struct("doc", "no")
    candidates = lines.filter(F.col("n") >= min_words).join(if_small(found), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min(place).alias("place"), F.min("n").alias("n"), F.min("line").alias("line"))
    candidates = stored(candidates, "line-candidates")
    sizes = members.groupBy("key").agg(F.count("*").alias("lines"))
    sized = members.join(sizes, "key").join(candidates.select("h1", "h2", "place"), ["h1", "h2"])
    few = sized.filter(F.col("lines") <= SMALL_GROUP).select("key", "h1", "h2", "place")
    other = few.select("key", F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("place").alias("earlier"))
    pairs = few.join(other, "key").filter(F.col("earlier") < F.col("place")).select("h1", "h2", "e1", "e2")
    many = candidates.join(sized.filter(F.col("lines") > SMALL_GROUP).select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    variants = stored(full_variants(many), "line-variants").join(many.select("h1", "h2", "place"), ["h1", "h2"])
    earliest = variants.groupBy("key").agg(F.min(F.struct("place", "h1", "h2")).alias("first")).select("key", "first.*").toDF("key", "earlier", "e1", "e2")
    met = variants.join(earliest, "key").filter(F.col("earlier") < F.col("place")).select("h1", "h2", "e1", "e2")
    both = pairs.union(met).distinct()
    later = candidates.select("h1", "h2", F.split("line", " ").alias("later"))
    sooner = candidates.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.split("line", " ").alias("sooner"), F.col("place").alias("near"))
    verified = both.join(later, ["h1", "h2"]).join(sooner, ["e1", "e2"]).filter(within_one_word(F.col("later"), F.col("sooner")))
    return verified.groupBy("h1", "h2").agg(F.min("near").alias("near"))


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, row, no): the lines that are removed, once each. Rows that share an id are told apart by their texts."""
    lines = text_lines(docs)
    near = stored(near_lines(lines, min_words), "line-near")
    repeated = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc", "no")).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    kept = repeated.join(near, ["h1", "h2"], "full").select("h1", "h2", F.least("first", "near").alias("kept"))
    return lines.select("h1", "h2", "doc", "row", "no").join(kept, ["h1", "h2"]).filter(F.struct("doc", "no") > F.col("kept")).select("doc", "row", "no")


def line_dedup(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, n_lines, n_removed, kept_text), one for each row.

    A row's removed lines are collected (no more than it has), and left out by one pass over the places of its lines.
    """
    gone = removed_lines(docs, min_words).groupBy("doc", "row").agg(F.collect_set("no").alias("gone"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), row_key().alias("row"), F.split(text, "\n").alias("parts")).join(gone, ["doc", "row"], "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("parts")).otherwise(F.transform(places, lambda k: F.get("parts", k)))
    return rows.select("doc_id", F.size("parts").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"), F.array_join(left, "\n").alias("kept_text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
every AS (SELECT doc_id, unnest(range(len(l))) AS no, unnest(l) AS line FROM parts),
placed AS (SELECT *, row_number() OVER (ORDER BY doc_id, no) AS place FROM every),
lines AS (SELECT * FROM placed WHERE NOT regexp_full_match(line, '[\x20\x09-\x0D]*')),
classes AS (SELECT line, min(place) AS first, string_split(line, ' ') AS w FROM lines GROUP BY line),
variants AS (
  SELECT line, first, w, unnest(range(1, len(w) + 2)) AS k FROM classes WHERE len(w) >= 8),
keys AS (
  SELECT line, first, md5(k || '|' || array_to_string(w[:k - 1], ' ') || chr(1) || array_to_string(w[k + 1:], ' ')) AS key FROM variants WHERE k <= len(w)
  UNION ALL
  SELECT line, first, md5(k || '|' || array_to_string(w[:k - 1], ' ') || chr(1) || array_to_string(w[k:], ' ')) AS key FROM variants),
earliest AS (SELECT key, min(first) AS first FROM keys GROUP BY key),
near AS (SELECT line, min(earliest.first) AS first FROM keys JOIN earliest USING (key) GROUP BY line),
kept AS (SELECT classes.line, least(classes.first, coalesce(near.first, classes.first)) AS first FROM classes LEFT JOIN near USING (line)),
flags AS (
  SELECT placed.doc_id, placed.no, placed.line, coalesce(placed.place > kept.first AND NOT regexp_full_match(placed.line, '[\x20\x09-\x0D]*'), false) AS gone
  FROM placed LEFT JOIN kept USING (line))
SELECT doc_id, count(*) AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM flags GROUP BY doc_id
"""
