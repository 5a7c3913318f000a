"""What the jobs share: their settings and their command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def settings(name: str, given: dict | None = None) -> dict:
    """The settings file beside a job, with what is given in place of its values. Names that the file lacks are errors."""
    own = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    if unknown := (given or {}).keys() - own.keys():
        raise ValueError(f"{name} has no setting {', '.join(sorted(unknown))}")
    return own | (given or {})


def command_line(run: Callable, about: str, *paths: str) -> None:
    """Runs a job with paths as arguments in a session of its own. --config: a JSON file with settings, read through Spark."""
    parser = argparse.ArgumentParser(description=about)
    for name in paths:
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(Path(run.__code__.co_filename).stem).getOrCreate()
    try:
        config = json.loads(spark.read.text(given.config, wholetext=True).first()[0]) if given.config else None
        run(spark, *(getattr(given, name) for name in paths), config)
    finally:
        spark.stop()


def parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a job has written at a path, partition columns of the schema's kinds; no rows before the first time."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
