"""Folders as a data source: trees are listed and read by the tasks, a subtree each.

    spark.dataSource.register(FolderDataSource)
    spark.read.format("lodestone_folder").option("path", "hdfs:///docs").load()

Rows (relative, byte_size, content, error): one a file, those whose name or folder begins with an underscore too; what
can't be read has an error and no content. Names that begin with a dot are left out, but for files of ignore rules. The
driver lists folders only until there are enough subtrees for all tasks, PARTS at most or a little above.

Options: path; contents (all, none, or rules: files of ignore rules, which are not returned otherwise); most_bytes (larger files are
errors); extensions (those of the files to return, by commas, in lower case; all without it). Paths are those that pyarrow's file systems read: local or mounted folders, hdfs, s3, gs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files of ignore rules, the later over the earlier.
IGNORE_FILES = (".gitignore", ".ignore", ".lodestoneignore")
#: Subtrees that the driver looks for, and how deep.
PARTS, DEEPEST = 256, 4
#: A batch of rows holds so many files or bytes.
BATCH_FILES, BATCH_BYTES = 512, 16 << 20
SCHEMA = "relative string, byte_size bigint, content binary, error string"
ARROW = pa.schema([("relative", pa.string()), ("byte_size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])


class Subtree(InputPartition):
    """A folder with all below it, or its own files only."""

    def __init__(self, relative: str, whole: bool) -> None:
        super().__init__((relative, whole))
        self.relative, self.whole = relative, whole


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").strip("/")
    own, at = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return own, at.rstrip("/")


def can_open(path: str) -> bool:
    """Whether pyarrow has a file system for a path, and finds a folder there."""
    try:
        own, at = _opened(path)
        return own.get_file_info(at).type == fs.FileType.Directory
    except (OSError, ValueError, NotImplementedError):
        return False


def _hidden(name: str) -> bool:
    return name.startswith(".") and name not in IGNORE_FILES


class FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.contents, self.most = options["path"], options.get("contents", "all"), int(options.get("most_bytes", 1 << 30))
        self.parts = int(options.get("parts", PARTS))
        self.kinds = set(options["extensions"].split(",")) if options.get("extensions") else None

    def _listed(self, own: fs.FileSystem, at: str) -> list[fs.FileInfo]:
        return sorted((f for f in own.get_file_info(fs.FileSelector(at)) if not _hidden(f.base_name)), key=lambda f: f.path)

    def partitions(self) -> list[Subtree]:
        own, top = _opened(self.path)
        out, level = [], [""]
        for _ in range(DEEPEST):
            if not level or len(out) + len(level) >= self.parts:
                break
            below = []
            for relative in level:
                out.append(Subtree(relative, False))
                below += [f.path[len(top) + 1 :] for f in self._listed(own, f"{top}/{relative}".rstrip("/")) if f.type == fs.FileType.Directory]
            level = below
        return out + [Subtree(relative, True) for relative in level]

    def _files(self, own: fs.FileSystem, at: str, whole: bool) -> Iterator[fs.FileInfo]:
        todo = [at]
        while todo:
            here = todo.pop()
            for f in self._listed(own, here):
                if f.type != fs.FileType.Directory:
                    yield f
                elif whole:
                    todo.append(f.path)

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        own, top = _opened(self.path)
        rows, size = [], 0
        for f in self._files(own, f"{top}/{partition.relative}".rstrip("/"), partition.whole):
            rules = f.base_name in IGNORE_FILES
            if rules != (self.contents == "rules") or not (rules or self.kinds is None or f.extension.lower() in self.kinds):
                continue
            content = error = None
            if f.type != fs.FileType.File:
                error = "not a file that can be read"
            elif self.contents != "none":
                try:
                    if (f.size or 0) > self.most:
                        raise OSError(f"over {self.most} bytes")
                    with own.open_input_stream(f.path) as stream:
                        content = stream.read()
                except OSError as e:
                    error = str(e)
            rows.append((f.path[len(top) + 1 :], f.size, content, error))
            size += len(content or b"")
            if len(rows) == BATCH_FILES or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class FolderDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestone_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:  # noqa: ANN001
        return FolderReader(self.options)


def scan_folder(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """Rows of the source for a path."""
    spark.dataSource.register(FolderDataSource)
    return spark.read.format(FolderDataSource.name()).options(path=path, **options).load()
