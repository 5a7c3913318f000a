"""Runnable jobs, and each as a query over the given tables with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evidence, feed_chunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_feed_chunks": feed_chunks.job1_feed_chunks, "job2_evidence": evidence.job2_evidence}
ORACLE: dict[str, str] = {"job1_feed_chunks": feed_chunks.JOB1_SQL, "job2_evidence": evidence.JOB2_SQL}
