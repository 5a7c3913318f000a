"""Question answering: retrieve, gate, pack, ask a language model, check citations, keep the record."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncated
from ..operators import services
from ..operators.citations import DECLINED, SYSTEM_PROMPT, cited, context_block, prompt, used_flags, without_unknown
from ..operators.fusion import pack_stopping, rejected


class Llm(Protocol):
    model_id: str

    def generate(self, system: str, prompt: str) -> str: ...


@dataclass(frozen=True)
class MockLlm:
    """Says one sentence, with a citation if given one."""

    cite: str | None = None
    model_id: str = "mock-llm"

    def generate(self, system: str, prompt: str) -> str:
        return f"This is a grounded answer [^{self.cite}]." if self.cite else "This is a grounded answer."


def answer(questions: DataFrame, hits: DataFrame, llm: Llm | Callable[[str, str], str], keep: str, *, budget: int = 6000, threshold: float = 0.15, manners: services.Manners | None = None) -> tuple[DataFrame, DataFrame]:
    """questions (query_id, text) with their hits (query_id, rank, chunk_id, path_or_url, text, score) to two frames.

    A model may answer otherwise when asked again, so contexts and raw answers are written under `keep`, a new path in
    a folder that all executors share, and all else is derived from there: a lost executor asks nothing twice that was written.

    Answers: query_id, answer, answer_clean, rejected. Citations: one row for each chunk that was in a context, with
    score and used_in_answer. Rejected questions don't reach the model and have no citations.
    """
    generate = llm if callable(llm) else llm.generate
    gate = rejected(questions, hits, threshold)
    spark = questions.sparkSession
    pack_stopping(hits.join(gate.filter("not rejected"), "query_id", "left_semi"), budget).write.parquet(f"{keep}/contexts")
    packed = spark.read.parquet(f"{keep}/contexts")
    valid = packed.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("valid"))
    asked = questions.join(gate, "query_id").join(context_block(packed), "query_id", "left").join(valid, "query_id", "left")
    asked = asked.withColumn("request", F.when(~F.col("rejected"), prompt(F.col("text"), F.col("context"))))
    # several requests in flight a task, one for each distinct prompt, kept as soon as they are answered
    said = services.asked(asked.select("request"), functools.partial(generate, SYSTEM_PROMPT), f"{keep}/said", manners=manners)
    told = said.select("key", F.when(F.col("error").isNull(), F.col("answer")).otherwise(F.raise_error(F.concat(F.lit("the model did not answer: "), "error"))).alias("raw"))
    asked.withColumn("key", F.sha2("request", 256)).join(told, "key", "left").select("query_id", "text", "rejected", "valid", "raw").write.parquet(f"{keep}/raw")
    raw = spark.read.parquet(f"{keep}/raw")
    answers = raw.select("query_id", "text", F.when(F.col("rejected"), DECLINED).otherwise(F.col("raw")).alias("answer"), F.when(F.col("rejected"), DECLINED).otherwise(without_unknown(F.col("raw"), F.col("valid"))).alias("answer_clean"), "rejected", F.when(F.col("rejected"), F.array().cast("array<string>")).otherwise(cited(F.col("raw"), F.col("valid"))).alias("cited"))
    citations = used_flags(packed.select("query_id", "rank", "chunk_id", "path_or_url", "text", "score"), answers, ["query_id"])
    return answers, citations


def thread(messages: DataFrame, conversation: str, *order: str, role: str = "role") -> DataFrame:
    """Messages with their place in the conversation, from 1, and the role that spoke before (null at the start)."""
    own = Window.partitionBy(conversation).orderBy(*order)
    return messages.withColumn("nth", F.row_number().over(own)).withColumn("before", F.lag(role).over(own))


def conversation_rows(answers: DataFrame, citations: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """What a store keeps of answers: conversations, both messages of each, and the citations."""
    ids = answers.withColumn("conversation_id", F.sha2(F.concat_ws("\u0001", F.lit(str(now_ms)), F.col("query_id").cast("string")), 256))
    stamp = F.lit(now_ms).alias("created_at")
    message = lambda role, content: ids.select(F.concat("conversation_id", F.lit(f"-{role}")).alias("id"), "conversation_id", F.lit(role).alias("role"), F.col(content).alias("content"), stamp)
    cites = citations.join(ids.select("query_id", "conversation_id"), "query_id")
    return {
        "conversation": ids.select(F.col("conversation_id").alias("id"), truncated(F.col("text")).alias("title"), stamp),
        "message": message("user", "text").unionByName(message("assistant", "answer")),
        "citation": cites.select(F.concat("conversation_id", F.lit("-assistant")).alias("message_id"), "chunk_id", F.col("score").cast("double").alias("retrieved_score"), "used_in_answer"),
    }
