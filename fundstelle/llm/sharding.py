"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

SHARD_BYTES = 64 << 20
MIN_SHARDS = 8
SHARDS_PER_BUCKET = 8
CELLS_PER_BUCKET = 64


def karmarkar_karp(sizes: list[int], k: int) -> list[int]:
    """A part in 0..k-1 for each size, by largest-spread-first differencing.

    Every size starts as a partial partition whose other k-1 sums are 0. The two partial partitions of
    largest spread are combined, the largest sum of one with the smallest of the other, until one is
    left. Ties go by the order of creation, so the answer depends on the order of ``sizes`` alone.
    Sums of 0 are left out of the tuples, so the early rounds cost what they hold, not k.
    """
    n = len(sizes)
    if n == 0:
        return []
    if k <= 1:
        return [0] * n
    left, right = [-1] * n, [-1] * n  # trees of slots: a leaf is an item
    heap: list[tuple[int, int, list[int], list[int]]] = [(-s, i, [s], [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, sa, ta = heapq.heappop(heap)
        _, _, sb, tb = heapq.heappop(heap)
        # both are in descending order and lack their zeros
        room = k - len(sa)
        sums, tops = sa + sb[:room], ta + tb[:room]  # the largest of b onto a's zeros
        for j in range(room, len(sb)):  # and so on upwards
            x = k - 1 - j
            left.append(ta[x])
            right.append(tb[j])
            tops[x] = len(left) - 1
            sums[x] = sa[x] + sb[j]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, tops = [sums[i] for i in order], [tops[i] for i in order]
        spread = sums[0] - (sums[-1] if len(sums) == k else 0)
        heapq.heappush(heap, (-spread, made, sums, tops))
        made += 1
    part = [0] * n
    for p, top in enumerate(heap[0][3]):
        stack = [top]
        while stack:
            node = stack.pop()
            if node < n:
                part[node] = p
            else:
                stack += (left[node], right[node])
    return part


def _split_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["bytes", "group"], ascending=[False, True], kind="stable", ignore_index=True)
    part = karmarkar_karp(pdf["bytes"].tolist(), int(pdf["k"].iloc[0])) if len(pdf) else []
    return pd.DataFrame({"group": pdf["group"], "shard": np.asarray(part, np.int64) + pdf["first"]})


def shard_groups(
    docs: DataFrame,
    group: Column | None = None,
    shard_bytes: int = SHARD_BYTES,
    min_shards: int = MIN_SHARDS,
    shards_per_bucket: int = SHARDS_PER_BUCKET,
) -> DataFrame:
    """Give every document a shard such that no group is split and the shards' bytes are close.

    A group is the set of rows of equal ``group``, by default those of equal text, so copies stay
    together. The shards are ``max(min_shards, bytes / shard_bytes)``. Groups are hashed to cells; the
    cells' byte sums (64 for each bucket of 8 shards, so a thousandth of a shard list, never rows) are
    differenced on the driver into buckets of near-equal bytes, and each bucket's groups are differenced
    into its shards in one task. A task holds ``shards_per_bucket * shard_bytes`` worth of group sizes
    (16 bytes a group), whatever the corpus.

    Returns ``(doc_id, shard, n_bytes)``, a row for each input row, other columns are not carried.
    Null text has 0 bytes. A null group is a group of its own row; rows repeated as a whole stay
    together. Null ids are kept. An empty table gives no rows.
    """
    spark = docs.sparkSession
    key = F.unhex(F.md5("text")) if group is None else F.unhex(F.md5(group.cast("string")))
    own = F.unhex(F.md5(F.concat_ws("|", F.lit("null group"), F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(key, own).alias("group"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    groups = written(rows.groupBy("group").agg(F.sum("n_bytes").alias("bytes")))
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shards = max(min_shards, math.ceil(total / shard_bytes))
    buckets = math.ceil(shards / shards_per_bucket)
    cells = buckets * CELLS_PER_BUCKET
    cell = F.pmod(F.xxhash64("group"), F.lit(cells))
    sums = {r[0]: int(r[1]) for r in groups.groupBy(cell.alias("cell")).agg(F.sum("bytes")).collect()}
    bucket_of = karmarkar_karp([sums.get(c, 0) for c in range(cells)], buckets)
    bounds = [b * shards // buckets for b in range(buckets + 1)]
    plan = pd.DataFrame({"cell": np.arange(cells, dtype=np.int64), "bucket": np.array(bucket_of, np.int64)})
    plan["first"] = np.array(bounds, np.int64)[plan["bucket"]]
    plan["k"] = np.diff(np.array(bounds, np.int64))[plan["bucket"]]
    table = spark.createDataFrame(plan, "cell long, bucket long, first long, k long")
    if cells <= 1 << 16:  # 2 MB; beyond that Spark picks the join by size
        table = F.broadcast(table)
    placed = groups.withColumn("cell", cell).join(table, "cell").select("group", "bytes", "bucket", "first", "k")
    placed = placed.groupBy("bucket").applyInPandas(lambda pdf: _split_bucket(pdf), "group binary, shard long")
    return rows.join(placed, "group").select("doc_id", "shard", "n_bytes")


def op1_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_groups(documents(spark, sf_dir))
