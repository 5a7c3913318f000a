"""Prompts and the citations of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM_PROMPT = (
    "Answer from the given context only. Put the marker [^chunk_id] of the chunk that supports it behind every claim, with the id "
    "exactly as the context gives it, and no other ids. If the context does not answer the question, say so and name what is missing."
)
DECLINED = "The indexed sources don't hold enough to answer that. Add a source that does, or put the question in other words."


def context_block(packed: DataFrame) -> DataFrame:
    """(query_id, context): the packed chunks in rank order, each under its marker and source."""
    line = F.concat(F.lit("[^"), F.col("chunk_id"), F.lit("] (source: "), F.coalesce("path_or_url", F.lit("")), F.lit("):\n"), F.col("text"), F.lit("\n\n"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return packed.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("context"))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n---\nQuestion: "), question, F.lit("\n\nAnswer from the context above, each claim with its [^chunk_id]."))


def cited(answer: Column, valid: Column) -> Column:
    """Ids that the answer's markers name, in the order of first use, of those in the array valid."""
    found = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[\^([^\]]*)\]"), 1))
    return F.filter(found, lambda x: F.array_contains(valid, x))


def without_unknown(answer: Column, valid: Column) -> Column:
    """The answer without markers of ids that are not valid."""
    parts = F.split(answer, r"(?=\[\^[^\]]*\])|(?<=\])")
    marker = r"^\[\^([^\]]*)\]$"
    known = lambda p: ~p.rlike(marker) | F.array_contains(valid, F.regexp_extract(p, marker, 1))
    return F.array_join(F.filter(parts, known), "")


def used_flags(context: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of contexts (keys, chunk_id, ...) with used_in_answer: whether the answer (keys, cited) names the chunk."""
    both = context.join(answers.select(*keys, "cited"), keys)
    return both.withColumn("used_in_answer", F.array_contains("cited", F.col("chunk_id"))).drop("cited")
