"""A workspace's tables as Parquet files that are only ever added.

A commit writes rows and deleted keys under a number of its own and becomes visible, in all its tables at once, by
one small manifest file, which is there whole or not at all, and only if no other commit took that number. A manifest can say which parts it
replaces (compact), and every STATE_EVERY-th carries the whole state, so that reading begins there. Reading a table takes each
key's newest row, unless it was deleted later: the first part stands as it is if its keys are unique, but for keys that
later parts have, so that only what came later is sorted by key.
"""

from __future__ import annotations

import functools
import json
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import KEYS, SCHEMA_VERSION, table_schema, violations

#: Tables that a row of a table takes with it when it goes: (child, its column, the parent's key).
CHILDREN = {
    "source": [("document", "source_id")],
    "document": [("chunk", "document_id"), ("chunk_vector", "document_id")],
    "chunk": [("embedding", "chunk_id")],
    "conversation": [("message", "conversation_id")],
    "message": [("citation", "message_id")],
}


#: Manifests with the whole state.
STATE_EVERY = 50
#: What brings a store of a version to the next one: functions of the store, by version.
MIGRATIONS: dict[int, Callable[[Store], None]] = {}


#: Local file systems look for the target and rename in two steps.
PUBLISHING = threading.Lock()


class Conflict(RuntimeError):
    """Another commit took the number first, or changed what this one was computed from."""


class Store:
    """Opens the store at path, made by its first commit. A store of a newer version is an error, one of an older version is migrated."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf)
        if (version := self.state()["schema"]) > SCHEMA_VERSION:
            raise ValueError(f"the store has version {version}, this library reads up to {SCHEMA_VERSION}")
        for step in range(version, SCHEMA_VERSION):
            MIGRATIONS[step](self)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self, *, whole: bool = True) -> list[int]:
        """The commits' numbers; with whole=False those too that an empty manifest has taken."""
        if not self._fs.exists(self._at("commits")):
            return []
        found = [(f.getPath().getName(), f.getLen()) for f in self._fs.listStatus(self._at("commits"))]
        return sorted(int(name.removesuffix(".json")) for name, size in found if name.endswith(".json") and not name.startswith(".") and (size or not whole))

    def _manifest(self, number: int) -> dict:
        stream = self._fs.open(self._at(f"commits/{number:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifests(self, after: int = 0) -> list[dict]:
        """The commits after a number, in their order."""
        return [self._manifest(n) for n in self._numbers() if n > after]

    def state(self) -> dict:
        """The number of the last commit, the version, and for each table its live parts of rows and of deleted keys as [number, part, whether its keys are unique]."""
        now, newer = {"number": 0, "schema": SCHEMA_VERSION, "tables": {}}, []
        for number in reversed(self._numbers()):
            entry = self._manifest(number)
            newer.append(entry)
            if "state" in entry:
                now = entry["state"]
                newer.pop()
                break
        for entry in reversed(newer):
            now = after(now, entry)
        return now

    def version(self) -> int:
        return (self._numbers(whole=False) or [0])[-1]

    def commit(self, rows: dict[str, DataFrame] | None = None, deleted: dict[str, DataFrame] | None = None, *, unique: bool = False, base: int | None = None, reads: tuple[str, ...] = ()) -> int:
        """Adds rows, and deletes keys, of any tables together. Rows win over deletions of one commit.

        unique: no key repeats in a table's rows. base: the version that the rows were computed from; it is a conflict if a
        later commit touched one of the tables in `reads`.
        """
        return self._write({t: self._typed(t, df) for t, df in (rows or {}).items()}, deleted or {}, unique, base, reads, {})

    def _typed(self, table: str, df: DataFrame) -> DataFrame:
        schema = table_schema(table)
        typed = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        bad = F.size(violations(table)) > 0
        return typed.withColumn(schema[0].name, F.when(bad, F.raise_error(F.concat(F.lit(f"{table}: value outside its domain: "), F.array_join(violations(table), ", ")))).otherwise(F.col(schema[0].name)))

    def _write(self, rows: dict[str, DataFrame], deleted: dict[str, DataFrame], unique: bool, base: int | None, reads: tuple[str, ...], replaces: dict[str, list[str]]) -> int:
        number = self.version() + 1
        own = f"{number}-{uuid.uuid4().hex}"  # another commit that tries for the number writes elsewhere
        entry: dict = {"number": number, "schema": SCHEMA_VERSION, "rows": {}, "deleted": {}, "unique": unique, "replaces": replaces}
        parts = []
        for table, df in rows.items():
            entry["rows"][table] = f"{table}/rows-{own}"
            parts.append((df if "_commit" in df.columns else df.withColumn("_commit", F.lit(number)), entry["rows"][table]))
        for table, df in deleted.items():
            entry["deleted"][table] = f"{table}/deleted-{own}"
            parts.append((df.select(KEYS[table]).withColumn("_commit", F.lit(number)), entry["deleted"][table]))
        # small tables need not wait for large ones
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda x: x[0].write.parquet(f"{self.path}/{x[1]}"), parts))
        if base is not None:
            for other in self.manifests(base):
                if touched := ({*other["rows"], *other["deleted"]} - {*other["replaces"]}) & {*reads}:
                    raise Conflict(f"commit {other['number']} changed {', '.join(sorted(touched))}")
        if number % STATE_EVERY == 0:
            entry["state"] = after(self.state(), entry)
        self._publish(number, json.dumps(entry))
        return number

    def _publish(self, number: int, text: str) -> None:
        """A manifest is there whole or not at all: written under a hidden name, then renamed, which fails where the number is taken."""
        hidden, target = self._at(f"commits/.{number:012d}-{uuid.uuid4().hex}"), self._at(f"commits/{number:012d}.json")
        stream = self._fs.create(hidden, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            with PUBLISHING:
                files.rename(hidden, target, options)
        except Exception as e:
            self._fs.delete(hidden, False)
            raise Conflict(str(e)) from e

    def read(self, table: str) -> DataFrame:
        return self._read(table, self.state()).drop("_commit")

    def _read(self, table: str, state: dict) -> DataFrame:
        keys, parts = KEYS[table], state["tables"].get(table, {"rows": [], "deleted": []})
        schema = table_schema(table).add("_commit", T.IntegerType())
        load = lambda own: self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for _, p, _ in own))
        gone = lambda own: self.spark.read.parquet(*(f"{self.path}/{p}" for _, p, _ in own))
        live, dead = parts["rows"], parts["deleted"]
        if not live:
            return self.spark.createDataFrame([], schema)
        first, later = (live[0], live[1:]) if live[0][2] else (None, live)
        out = []
        if first:
            newer = [load(later).select(keys)] if later else []
            newer += [gone(some).select(keys)] if (some := [d for d in dead if d[0] > first[0]]) else []
            whole = load([first])
            out.append(whole.join(functools.reduce(DataFrame.union, newer), keys, "left_anti").select(whole.columns) if newer else whole)
        if later:
            newest = Window.partitionBy(*keys).orderBy(F.desc("_commit"))
            rows = load(later).withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth")
            if dead:
                last = gone(dead).groupBy(keys).agg(F.max("_commit").alias("_gone"))
                rows = rows.join(last, keys, "left").filter("_gone is null or _gone <= _commit").select(schema.fieldNames())
            out.append(rows)
        return functools.reduce(DataFrame.unionByName, out)

    def find(self, table: str, wanted: DataFrame, *columns: str) -> DataFrame:
        """The table's rows whose columns (its key, if none are named) have the values of a row of `wanted`: a batch of lookups is one join."""
        names = list(columns) or KEYS[table]
        return self.read(table).join(wanted.select(names).distinct(), names, "left_semi")

    def upsert(self, table: str, rows: DataFrame, order: str | None = None) -> int:
        """Rows that replace those of their keys. Of rows that repeat a key the one with the largest `order` counts; without an order, rows that repeat a key and differ are an error."""
        own = F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in table_schema(table)))
        whole = rows.select(own.alias("r"), (F.lit(0) if order is None else F.col(order)).alias("o"))
        best = whole.groupBy(*(F.col(f"r.{k}").alias(k) for k in KEYS[table])).agg(F.max(F.struct("o", "r")).alias("most"), F.min("r").alias("least"))
        if order is None:
            name = F.concat_ws(", ", *(F.col(k).cast("string") for k in KEYS[table]))
            differ = F.raise_error(F.concat(F.lit(f"{table}: rows that differ repeat the key "), name))
            best = best.withColumn("most", F.when(F.col("most.r").eqNullSafe(F.col("least")), F.col("most")).otherwise(differ))
        return self.commit({table: best.select("most.r.*")}, unique=True)

    def below(self, table: str, keys: DataFrame) -> dict[str, DataFrame]:
        """The keys, and those of all rows in other tables that go with them. Citations of a chunk stay, as a record of what was said."""
        out, todo = {table: keys}, [(table, keys)]
        while todo:
            parent, ids = todo.pop()
            for child, column in CHILDREN.get(parent, []):
                own = self.find(child, ids.select(F.col(KEYS[parent][0]).alias(column)), column).select(KEYS[child])
                out[child] = own
                todo.append((child, own))
        return out

    def delete(self, table: str, keys: DataFrame) -> int:
        """Deletes with cascade, in one commit."""
        return self.commit(deleted=self.below(table, keys))

    def compact(self, table: str) -> int:
        """One part with what is read now, in place of all parts so far; those stay for readers that have begun.

        Rows keep the number of their commit, so a deletion that is committed meanwhile still finds them older than itself.
        """
        state = self.state()
        parts = state["tables"].get(table, {"rows": [], "deleted": []})
        return self._write({table: self._read(table, state)}, {}, True, None, (), {table: [p for _, p, _ in [*parts["rows"], *parts["deleted"]]]})

    def tables(self) -> list[str]:
        """The tables that have been written."""
        return sorted(t for t, parts in self.state()["tables"].items() if parts["rows"])


def after(state: dict, entry: dict) -> dict:
    """The state once a commit is added. What replaces other parts stands where they stood, before what was added meanwhile."""
    tables = {t: {kind: list(parts[kind]) for kind in ("rows", "deleted")} for t, parts in state["tables"].items()}
    for kind in ("rows", "deleted"):
        for table, part in entry[kind].items():
            own = tables.setdefault(table, {"rows": [], "deleted": []})
            gone = set(entry["replaces"].get(table, ()))
            if not gone:
                own[kind].append([entry["number"], part, entry["unique"]])
                continue
            newest = max(n for n, p, _ in [*own["rows"], *own["deleted"]] if p in gone)
            for k in own:
                own[k] = [x for x in own[k] if x[1] not in gone]
            own[kind].insert(0, [newest, part, True])
    return {"number": entry["number"], "schema": entry["schema"], "tables": tables}
