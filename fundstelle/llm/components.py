"""Distributed union-find over an edge table: alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, tidy, written

#: Edges (16 bytes each, after each partition's union-find) up to which one task joins what is left.
ONE_TASK = 1 << 19


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find within one partition: its edges shrink to one per joined node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    nodes = list(parent)
    roots = [find(x) for x in nodes]
    keep = [(x, r) for x, r in zip(nodes, roots) if x != r]
    for at in range(0, len(keep), 100_000):
        part = np.array(keep[at : at + 100_000], np.int64)
        yield pa.record_batch([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["u", "v"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``(node, root)`` of every node that an edge ``(u, v)`` of two integers touches; root is the least node.

    Null ends and loops are ignored. Each partition joins its own edges first; up to ``one_task`` edges that remain are
    joined in one task, and more of them in rounds: every round is two narrow shuffles of the remaining edges with
    map-side combining; the rounds grow with the logarithm of the longest path, and the table of each
    is written to the shared folder, so a lost executor costs one round at most; ``release`` deletes the last
    one. A hub has one edge per neighbour, never pairs of neighbours.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    cur = written(e.mapInArrow(tidy(_local_forest), "u long, v long").distinct())
    if cur.count() <= one_task:
        done = written(cur.coalesce(1).mapInArrow(tidy(_local_forest), "u long, v long"))
        release(cur)
        return _members(done)
    while True:
        # large star: every larger neighbour of u links to the least node of u's neighbourhood
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours link to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        nxt = written(small)
        a = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        b = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(cur)
        cur = nxt
        if tuple(a) == tuple(b):
            break
    return _members(cur)


def _members(cur: DataFrame) -> DataFrame:
    """The members of stars ``(u, v)``, their centres too."""
    members = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = members.union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out._shared_path = cur._shared_path  # type: ignore[attr-defined]
    return out
