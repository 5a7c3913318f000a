"""Mixing sources to target weights.

Tokens are aggregated per source, repetition rates derived from the targets, and each document emitted
floor(rate) times plus one more time with probability equal to the fraction, decided by a seeded hash of its id.
Only DataFrame functions: no Python runs on the executors.

Defined results: a null or empty text has size 0; the null source is a source of its own and comes last in
code-point order; rows that repeat an id are drawn alike; a source whose sizes add up to 0 has target 0 and gives
nothing; an empty table gives an empty table. Other columns of the input pass through mix() untouched, whatever
their names, and are not read by mixing_plan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"
#: The table of sources is broadcast up to so many rows, a bound that is checked; beyond it the join shuffles.
BROADCAST_SOURCES = 10_000


def words_in(text: Column) -> Column:
    """How many words the text has: each, with the spaces before it, becomes one byte.

    regexp_count would build an array of all words, and gigabytes of garbage.
    """
    left = F.rtrim(F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x"), F.lit(" \t\n\v\f\r"))
    return F.coalesce(F.octet_length(left), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """(source, size) rows to one row per source: source, source_size, target.

    Targets share the sum of all sizes by weight; none exceeds max_repeats times its source's size, and what is
    above is shared again by weight. That is the water level L with sum(min(cap, weight * L)) = total: in the order
    of cap / weight, the first source whose level over all that follow it stays below its cap sets L.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * max_repeats)
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after, everything = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    per = per.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    per = per.withColumn("level", F.col("rest").cast("double") / F.sum("weight").over(after).cast("double"))
    open_ = F.col("level") * F.col("weight") <= F.col("cap")
    # levels rise until the first open source and never above its level afterwards
    per = per.withColumn("chosen", F.min(F.when(open_, F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(everything)["level"])
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("chosen"), F.lit(0.0)) * F.col("weight")).alias("target"))


def uniform(ident: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mixing_plan(docs: DataFrame, *, keep: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """Per row of docs: the columns in keep (default doc_id) as a struct `row`, and size, source_size, target, copies."""
    keep = ["doc_id"] if keep is None else keep
    col = lambda c: F.col("`" + c.replace("`", "``") + "`")
    sized = docs.select(F.struct(*[col(c) for c in keep]).alias("row"), F.col("doc_id").alias("ident"), F.col("source"), words_in(F.col("text")).alias("size"))
    targets = source_targets(docs.select("source", words_in(F.col("text")).alias("size")), weights, max_repeats)
    many = docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() > BROADCAST_SOURCES
    side = (targets if many else F.broadcast(targets)).withColumnRenamed("source", "of_source")
    both = sized.join(side, F.col("source").eqNullSafe(F.col("of_source")), "inner")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(0.0)
    both = both.withColumn("rate", rate)
    extra = (uniform(F.col("ident"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return both.select("row", "size", "source_size", "target", (F.floor("rate").cast("long") + extra).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: docs' own columns, each row as many times as the plan says."""
    plan = mixing_plan(docs, keep=docs.columns, **options)
    each = plan.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return each.select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return plan.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, source_size * 3 AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM per),
levels AS (
  SELECT *, cap / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
chosen AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE level * weight <= cap),
targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM chosen), 0.0) * weight) AS target FROM levels),
rates AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rates
"""
