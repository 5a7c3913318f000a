"""Links to components, and groups of rows to blocks that one task can compare."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


#: How often a label jumps to the label of its label in a round.
JUMPS = 3


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) to (node, component): the smallest node that each node reaches.

    In a round each node takes the smallest label around it, and so does the node that its label names, so that whole trees
    hook on to others; then labels jump to the labels of their labels. Rounds grow with the logarithm of the longest path (8 for
    1, 1000, 999, ..., 2). Every round aggregates before it shuffles and writes its labels to the shared folder once.
    """
    both = stored(links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        told = labels.join(near, F.col("node") == F.col("a"))
        own = F.struct("node", F.least("component", "c").alias("c"), F.col("component").alias("was"))
        root = F.struct(F.col("component").alias("node"), F.col("c"), F.lit(None).cast("long").alias("was"))
        # one stream of what nodes hear and what roots hear; a root's many messages are reduced before they are shuffled
        now = told.select(F.explode(F.array(own, root)).alias("m")).select("m.*").groupBy("node").agg(F.min("c").alias("c"), F.max("was").alias("was"))
        for _ in range(JUMPS):
            now = now.join(labels.select(F.col("node").alias("c"), F.col("component").alias("further")), "c").select("node", "was", F.least("c", "further").alias("c"))
        before, labels = labels, stored(now.select("node", "was", F.col("c").alias("component")), "labels")
        discard(before)
        if labels.filter("component <> was").isEmpty():
            discard(both)
            return labels.select("node", "component")


def in_blocks(rows: DataFrame, group: str, member: str, block: int, most: int | None = None) -> DataFrame:
    """rows whose group has at least two members, with i, j, own: the pair of blocks that a copy of the row serves, and the row's block.

    Groups of up to `block` rows, and with `most` of that weight together (column weight), are one block. Larger ones are
    dealt by a hash of the member to as many blocks as
    they need; each pair of blocks meets in one place, so no task gets more than about two blocks.
    """
    heavy = F.ceil(F.sum("weight") / most) if most else F.lit(1)
    sizes = rows.groupBy(group).agg(F.count("*").alias("n_members"), heavy.alias("heavy")).filter("n_members > 1")
    blocks = F.greatest(F.ceil(F.col("n_members") / block), F.col("heavy")).cast("int")
    both = rows.join(sizes, group).withColumn("blocks", blocks).drop("n_members", "heavy", "weight")
    both = both.withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return both.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Of rows sorted by keys, tables that hold whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            held.append(part)
            if sum(x.num_rows for x in held) < rows:
                continue
            table = pa.Table.from_batches(held)
            starts = group_starts(table, keys)
            last = int(starts[-1])
            if last:
                yield table.slice(0, last).combine_chunks()
            held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in keys:
        v = table[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest row number that each of n rows reaches by the links p-q."""
    low = np.arange(n)
    while len(p):
        was = low.copy()
        np.minimum.at(low, p, low[q])
        np.minimum.at(low, q, low[p])
        low = low[low]
        if (was == low).all():
            break
    return low
