"""What several of the operators share: the shared folder, tables written in it, and words."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The bytes that part words: space and 0x09 to 0x0D. bytes.split() without arguments parts at exactly these.
SPACES = b" \t\n\x0b\x0c\r"
#: The same as a pattern for Spark SQL and DuckDB, in runs.
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only on one machine (as in tests) is one made where it is unset."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _hadoop(spark: SparkSession, at: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def until_exit(spark: SparkSession, at: str) -> None:
    """What lies there is deleted when the driver ends, if not before."""
    files, path = _hadoop(spark, at)
    files.deleteOnExit(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts the lineage, and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As stored(), shuffled by key first, once and for all: joins and groups by key don't shuffle it again.

    Only a table of the catalog knows its buckets; the entry goes as soon as the frame has read it, the files stay.
    """
    spark, n = df.sparkSession, min(100_000, partitions(df.sparkSession))
    path, table = new_path(spark, name), f"lodestone_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "uncompressed").saveAsTable(table, format="parquet")
    until_exit(spark, path)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the tables of stored frames that nothing reads any more."""
    for df in frames:
        files, path = _hadoop(df.sparkSession, df.stored_at)
        files.delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of texts that go to a Python worker at once. Spark's own 10,000 are some 100 MB of texts on either side.
TEXT_ROWS = 1_000
ARROW_ROWS, SPARKS_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def text_rows(df: DataFrame) -> DataFrame:
    """df, whose texts go to Python workers. Where the session has Spark's default, it is set to TEXT_ROWS rows a batch."""
    conf = df.sparkSession.conf
    if conf.get(ARROW_ROWS) == SPARKS_ROWS:
        conf.set(ARROW_ROWS, TEXT_ROWS)
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
