"""Filter interaction audit: what each of several filters removes in every order of applying them.

One scan of the texts gives each row a mask of the filters that it fails, and the length and block hashes of its text.
Copies are found by partition refinement: rows are classes by their number of code points, then classes are split by
the hash of one block of the text after another, and rows alone in their class drop out before the next split. The full
texts of what survives are compared by bytes, and rows whose id is not the smallest of their text fail the last filter.
All figures follow from the number of rows by part and mask: 32 masks a part, whatever the number of rows.

Hot keys: classes are counted with partial aggregation and joined to rows as one row a class, so that a text in a third
of all rows splits in the join; equal texts collapse in the map tasks before they cross the shuffle. Hashes only save
work: a class that turns out to hold different texts is marked text by text.

Defined results: null counts as empty text, a null part as the empty string; null ids are larger than all others, and of
rows of one text that repeat the smallest id, or have null ids only, none fails as a copy; labels that repeat an id count
if any says so; labels of null ids match nothing; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, discard, read_table, stored

FILTERS = "ABCDE"
COPY_BIT = 1 << FILTERS.index("E")
#: Where the blocks of a text begin, in code points; the last one goes to the text's end.
BLOCKS = (0, 256, 2048, 16384)


def failed_filters(text: Column) -> Column:
    """The bits of A to D that a text fails."""
    spaced = F.regexp_replace(text, f"^{SPACE_PATTERN}|{SPACE_PATTERN}$", "")
    words = F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, SPACE_PATTERN))
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = (n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.char_length(text), text.rlike("[#$%&*|]"))
    bits = [F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)]
    return (bits[0] + bits[1] + bits[2] + bits[3]).cast("int")


def block_hashes(text: Column, bits: int = 64) -> list[Column]:
    """A hash of each block of BLOCKS; fewer bits make classes of different texts, for tests."""
    ends = [*(end - begin for begin, end in itertools.pairwise(BLOCKS)), (1 << 31) - 1]
    return [F.shiftright(F.xxhash64(F.substring(text, begin + 1, size)), 64 - bits) for begin, size in zip(BLOCKS, ends, strict=True)]


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(c).cast("string").alias(c) for c in more))


def profiles(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, part, mask, n_chars, h0, h1, ...): one row for each of docs, without its text."""
    rows = _texts(docs, "lang")
    return rows.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), failed_filters(F.col("text")).alias("mask"), *_class_keys(F.col("text"), bits))


def _class_keys(text: Column, bits: int) -> list[Column]:
    return [F.char_length(text).alias("n_chars"), *(h.alias(f"h{k}") for k, h in enumerate(block_hashes(text, bits)))]


#: What tells the classes of each round apart: the length, then one block more a round.
ROUNDS = [["n_chars", *(f"h{k}" for k in range(n))] for n in range(len(BLOCKS) + 1)]


def refined(rows: DataFrame) -> DataFrame:
    """The classes, (n_chars, h0, ...), that hold more than one row after all rounds: one row a class. rows is a stored frame."""
    left, classes = rows.select(ROUNDS[-1]), None
    for keys in ROUNDS:
        classes = left.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
        if keys != ROUNDS[-1]:
            before, left = left, stored(left.join(classes, keys, "left_semi"), "audit-refined")
            if hasattr(before, "stored_at"):
                discard(before)
    return classes.drop("n")


def owners(docs: DataFrame, classes: DataFrame, bits: int = 64) -> DataFrame:
    """The different full texts of these classes, with the smallest id of each: (n_chars, h0, ..., text, least)."""
    rows = _texts(docs).select("doc_id", "text", *_class_keys(F.col("text"), bits))
    # always a shuffle of the texts, which hot texts split: the plan is the same whatever the number of classes
    return rows.join(classes.hint("merge"), ROUNDS[-1], "left_semi").groupBy(*ROUNDS[-1], "text").agg(F.min("doc_id").alias("least"))


def masks(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, part, mask) with the bits of all five filters, one row for each of docs, a table or a stored frame."""
    keys = ROUNDS[-1]
    rows = stored(profiles(docs, bits), "audit-profiles")
    classes = stored(refined(rows), "audit-classes")
    verdict = stored(owners(docs, classes, bits).groupBy(*keys).agg(F.count("*").alias("n_texts"), F.min("least").alias("least")), "audit-verdict")
    copied = (F.col("doc_id") > F.col("least")) | (F.col("doc_id").isNull() & F.col("least").isNotNull())
    marked = (F.col("mask") + F.when(copied, COPY_BIT).otherwise(0)).alias("mask")
    plain = rows.join(verdict, keys, "left").filter("coalesce(n_texts, 1) = 1").select("doc_id", "part", marked)
    mixed = verdict.filter("n_texts > 1").select(keys)
    if mixed.isEmpty():
        return plain
    # the hashes of these classes agree and the texts don't: each row goes by its own text
    own = _texts(docs, "lang").join(owners(docs, mixed, bits).select("text", "least"), "text")
    return plain.unionByName(own.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), failed_filters(F.col("text")).alias("mask"), "least").select("doc_id", "part", marked))


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, own, before): each order's steps, a filter's bit and the bits of those applied before it. 600 rows."""
    rows = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order):
            own = 1 << FILTERS.index(letter)
            rows.append(("".join(order), k + 1, own, before))
            before |= own
    return spark.createDataFrame(rows, "filter_order string, step int, own int, before int")


def interactions(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, part, mask) and labels (doc_id, quality, toxic) to one row for each part, order and step."""
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = masked.join(told, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in ("good", "toxic")))
    # a filter removes the same rows whatever the order of those before it: 80 pairs of a filter and a set before it
    pairs = [F.struct(F.lit(1 << own).alias("own"), F.lit(before).alias("before")) for own in range(5) for before in range(32) if not before >> own & 1]
    each = counted.select("*", F.explode(F.array(*pairs)).alias("p")).select("part", "mask", "n", "good", "toxic", "p.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0

    def total(condition: Column, name: str, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0)).alias(name)

    sums = each.groupBy("part", "own", "before").agg(total(~fails & ~gone, "kept"), total(fails & ~gone, "removed"), total(fails & gone, "redundant"), total(F.col("mask") == F.col("own"), "unique_fails"), total(fails & ~gone, "good_lost", "good"), total(fails & ~gone, "toxic_lost", "toxic"))
    rows = sums.join(F.broadcast(steps(masked.sparkSession)), ["own", "before"])  # 600 rows
    shapley = F.sum("removed").over(Window.partitionBy("part", "own")).alias("shapley")
    return rows.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(masks(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "labels"))


OP11_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS words FROM documents),
f AS (SELECT doc_id, part, len(words) < 100 AS A, 100 * len(list_distinct(words)) < 80 * len(words) AS B, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS C,
  regexp_matches(text, '[#$%&*|]') AS D, count(*) OVER (PARTITION BY text ORDER BY doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) > 0 AS E FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * E::INT AS mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) AS r(step)),
g AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g"""
