"""Groups of bounded size, and connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashweave.llm.common import stored


def blocks(members: DataFrame, count: str, node: str, size: int) -> DataFrame:
    """Cut groups of more than ``size`` rows to chunks and pair the chunks up.

    ``count`` holds each row's group size, ``node`` what its chunk is drawn from. Adds ``left`` and ``right``, the
    chunk pair a row goes to, and ``side``, its own chunk; a row of a group with c chunks appears c
    times, so that any two rows of the group meet in exactly one pair of two chunks, or in one chunk.
    """
    chunks = F.ceil(F.col(count) / size).cast("int")
    return (members.withColumn("side", F.pmod(F.xxhash64(F.lit(77), node), chunks).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
            .withColumn("left", F.least("side", "_other")).withColumn("right", F.greatest("side", "_other")).drop("_other"))


def runs(batches, keys: int):
    """Yield tables of whole groups from batches sorted by their first ``keys`` columns, with the groups'
    bounds: (table, offsets). Rows of the last group wait for the next batch."""
    held = []

    def cut(table, last):
        change = np.zeros(table.num_rows, bool)
        for k in range(keys):
            column = table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change)])
        if last:
            return np.append(starts, table.num_rows), table.num_rows
        return starts, int(starts[-1])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        offsets, end = cut(table, False)
        if end:
            yield table.slice(0, end), offsets
        held = table.slice(end).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, cut(table, True)[0]


class Forest:
    """Union-find over 0 .. n-1 whose roots are the smallest members by ``ids``."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.parent = ids, list(range(len(ids)))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if self.ids[b] < self.ids[a]:
            a, b = b, a
        self.parent[b] = a
        return True

    def stars(self) -> list[tuple[int, int]]:
        """(member, root) of all that are not their own root."""
        return [(x, r) for x in range(len(self.parent)) if (r := self.root(x)) != x]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge to another.

    Alternating large-star and small-star steps: each connects the neighbours of a node to the
    smallest of them, so that every component ends as one star after O(log^2 n) rounds. A round moves
    the edges only, through partial minima and joins; it is stored, so a lost executor repeats one round.
    """
    def ordered(df, x, y):
        return df.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter("u <> v").distinct()

    def mark(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = stored(ordered(edges.select(a, b), a, b), "edges")
    seen = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = ordered(both.join(least, "u").filter("v > u"), "v", "m")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = ordered(small.select("v", "m").unionByName(low.select(F.col("u").alias("v"), "m")), "v", "m")
        now = stored(small, "edges")
        last, seen = seen, mark(now)
        if last == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
