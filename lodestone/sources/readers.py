"""Documents from folders, pages and tables, all as (path, title, mime, text_kind, byte_size, content_hash, text)."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, content_hash, file_name, html_text, html_title, lossy_utf8
from .folder_source import IGNORE_FILES, can_open, scan_folder
from .ignore import Rule, is_excluded, parse_rules

# The extensions that are read, by how they are cut in chunks.
MARKDOWN = ("md", "markdown", "mdx")
PLAIN = ("txt", "rst", "org")
CODE = (
    "rs", "ts", "tsx", "js", "jsx", "py", "go", "java", "kt", "c", "h", "cpp", "hpp", "cc", "cs", "rb", "php", "swift",
    "scala", "sh", "bash", "toml", "yaml", "yml", "json", "css", "scss", "html", "sql",
)



def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def text_kind(path: Column) -> Column:
    """markdown, plain, code, or null for files that aren't read."""
    e = extension(path)
    return F.when(e.isin(*MARKDOWN), "markdown").when(e.isin(*PLAIN), "plain").when(e.isin(*CODE), "code")


def mime_for(kind: Column) -> Column:
    return F.when(kind == "markdown", "text/markdown").otherwise("text/plain")


def qualified(spark: SparkSession, root: str):
    """The folder's Hadoop file system, and its path with scheme and host."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


def names_under(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(path below root, bytes) of all files, in order of their paths. Only names come to the driver, as they do in any scan."""
    fs, at = qualified(spark, root)
    top, files, out = at.toString().rstrip("/") + "/", fs.listFiles(at, True), []
    while files.hasNext():
        one = files.next()
        out.append((one.getPath().toString().removeprefix(top), one.getLen()))
    return sorted(out)


def ignore_rules(spark: SparkSession, root: str, names: list[tuple[str, int]] | None = None) -> list[Rule]:
    """The rules of all ignore files under root. Only these files come to the driver."""
    fs, at = qualified(spark, root)
    jvm, found = spark.sparkContext._jvm, []
    if names is None and can_open(root):
        for row in scan_folder(spark, at.toString(), contents="rules").filter("content is not null").collect():
            base, _, name = row["relative"].rpartition("/")
            found.append((IGNORE_FILES.index(name), base.count("/") + bool(base), base, bytes(row["content"]).decode("utf-8", "replace")))
        names = []
    for path, _ in names_under(spark, root) if names is None else names:
        base, _, name = path.rpartition("/")
        if name in IGNORE_FILES:
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(at, path))
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            found.append((IGNORE_FILES.index(name), base.count("/") + bool(base), base, text))
    return [rule for _, _, base, text in sorted(found) for rule in parse_rules(text.split("\n"), base)]


def list_folder(spark: SparkSession, root: str, *, rules: list[Rule] | None = None) -> DataFrame:
    """(path, relative, text_kind, byte_size) of the files that read_folder() reads, in order of their paths."""
    top = qualified(spark, root)[1].toString().rstrip("/") + "/"
    if can_open(root):
        own = ignore_rules(spark, root) if rules is None else rules
        found = scan_folder(spark, top, contents="none", extensions=EXTENSIONS).select("relative", "byte_size")
    else:
        names = names_under(spark, root)
        own = ignore_rules(spark, root, names) if rules is None else rules
        found = spark.createDataFrame(names, "relative string, byte_size bigint")
    found = found.withColumn("text_kind", text_kind(F.col("relative")))
    kept = found.filter("text_kind is not null").filter(~F.col("relative").rlike(r"(^|/)\.") & ~is_excluded(F.col("relative"), own))
    return kept.select(F.concat(F.lit(top), "relative").alias("path"), "relative", "text_kind", "byte_size").orderBy("path")


EXTENSIONS = ",".join((*MARKDOWN, *PLAIN, *CODE))

#: Spark's file scans leave out names that begin with an underscore. Where only they can open a path, such files are read under another name, from here.
VISIBLE = "visible"


def _visible(spark: SparkSession, root: str, under: str) -> str | None:
    """Copies of the files below root whose path Spark's scans leave out, in a folder under `under` with names that they don't."""
    fs, at = qualified(spark, root)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hidden = [p for p, _ in names_under(spark, root) if re.search(r"(^|/)_", p) and not re.search(r"(^|/)\.", p) and p.rpartition(".")[2].lower() in (*MARKDOWN, *PLAIN, *CODE)]
    if not hidden:
        return None
    target = f"{under.rstrip('/')}/{VISIBLE}-{uuid.uuid4().hex}"
    there = jvm.org.apache.hadoop.fs.Path(target).getFileSystem(conf)

    def copy(path: str) -> None:
        shown = "/".join(f"{VISIBLE}{part}" for part in path.split("/"))
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, jvm.org.apache.hadoop.fs.Path(at, path), there, jvm.org.apache.hadoop.fs.Path(f"{target}/{shown}"), False, conf)

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(copy, hidden))
    there.deleteOnExit(jvm.org.apache.hadoop.fs.Path(target))
    return target


def _plain(path: Column) -> Column:
    """file:/x and file:///x are one."""
    return F.regexp_replace(path, "^([a-z]+:)/+", "$1/")


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(relative, length, content) of what a scan finds under root."""
    top = qualified(spark, root)[1].toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(root)
    return files.select(F.substr(_plain(F.col("path")), F.char_length(_plain(F.lit(top))) + 2).alias("relative"), "length", "content")


def read_folder(spark: SparkSession, root: str, *, rules: list[Rule] | None = None, under: str | None = None, most_bytes: int = 1 << 30) -> DataFrame:
    """The files under root that have text: hidden and ignored ones are left out, bytes that aren't UTF-8 replaced.

    Trees that pyarrow's file systems open are listed and read by the tasks (scan_folder()), and a file that can't be read is
    a row without a text, as is one of over most_bytes. Others are read by Spark's file scan: files that can't be read are missing then, and count as failed
    when held against list_folder(). under: a folder that all executors share, for copies of files whose names begin
    with an underscore, which that scan leaves out; spark.checkpoint.dir if it is not given.
    """
    if can_open(root):
        found = scan_folder(spark, qualified(spark, root)[1].toString(), extensions=EXTENSIONS, most_bytes=most_bytes).select("relative", F.col("byte_size").alias("length"), "content")
    else:
        found, shared = _files(spark, root), under or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if at := _visible(spark, root, shared or f"file://{tempfile.gettempdir()}"):
            found = found.unionByName(_files(spark, at).withColumn("relative", F.regexp_replace("relative", f"(^|/){VISIBLE}", "$1")))
    top = qualified(spark, root)[1].toString().rstrip("/") + "/"
    found = found.withColumn("text_kind", text_kind(F.col("relative"))).filter("text_kind is not null")
    found = found.filter(~F.col("relative").rlike(r"(^|/)\.") & ~is_excluded(F.col("relative"), ignore_rules(spark, root) if rules is None else rules))
    text, path = lossy_utf8(F.col("content")), F.concat(F.lit(top), "relative")
    return found.select(path.alias("path"), file_name(path).alias("title"), mime_for(F.col("text_kind")).alias("mime"), "text_kind", F.col("length").alias("byte_size"), content_hash(F.col("content")).alias("content_hash"), text.alias("text"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. Where its files give fewer splits than there are cores (one row group is one split), its rows are dealt to all cores."""
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def read_pages(pages: DataFrame, url: str = "url", html: str = "html", *, strict_head: bool = True) -> DataFrame:
    """Web pages by their readable text."""
    page = pages.select(F.col(url).alias("path"), html_title(F.col(html)).alias("title"), html_text(F.coalesce(F.col(html), F.lit("")), strict_head=strict_head).alias("text"))
    return read_texts(page.withColumn("mime", F.lit("text/html")))


def read_texts(docs: DataFrame) -> DataFrame:
    """Any frame with path and text; title, mime and text_kind are filled in where it lacks them."""
    has = docs.columns
    kind = F.col("text_kind") if "text_kind" in has else F.lit("plain")
    title = F.col("title") if "title" in has else base_name(F.col("path"))
    mime = F.col("mime") if "mime" in has else mime_for(kind)
    return docs.select("path", title.alias("title"), mime.alias("mime"), kind.alias("text_kind"), F.octet_length("text").cast("long").alias("byte_size"), content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), "text")


def repo_slug(url: Column) -> Column:
    """org/repo of a git address, null if it has none."""
    clean = F.trim(url)
    ssh, web = F.regexp_extract(clean, r"^git@[^:]*:(.*)$", 1), F.regexp_extract(clean, r"^.*?://[^/]*/(.*)$", 1)
    path = F.when(clean.startswith("git@"), ssh).otherwise(web)
    slug = F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), r"(\.git)+$", "")
    return F.when(slug.contains("/"), slug)


def repo_error(url: Column) -> Column:
    """Why an address has no slug; null if it has."""
    clean = F.trim(url)
    return F.when(clean == "", "empty git url").when(repo_slug(url).isNotNull(), F.lit(None)).when(~clean.startswith("git@") & ~clean.contains("://"), "unrecognized git url").otherwise("no org/repo in the url")


def cache_name(slug: Column) -> Column:
    """A name for a folder: slashes become __, other signs _."""
    flat = F.regexp_replace(F.replace(slug, F.lit("/"), F.lit("\u0001")), r"[^\p{IsAlphabetic}\p{N}_\u0001-]", "_")
    return F.replace(flat, F.lit("\u0001"), F.lit("__"))


def repo_cache_root(workspace: str) -> str:
    return os.path.join(workspace, "repos")
