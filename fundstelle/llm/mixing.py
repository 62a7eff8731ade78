"""Sources mixed to target weights: fixed-length blocks, multinomial draws, index permutations, and a join."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, documents, mix64, pieces, text_buffer, tidy, word_spans, written

BLOCK_TOKENS = 1024
BLOCKS_PER_SHARD = 256
#: Longest token: text without white space is cut to pieces of so many bytes, about what BPE makes of it.
TOKEN_BYTES = 16
TEMPERATURE = 0.5
DOCS_PER_BUCKET = 4096
SEED = 17
JOINT = "\n\n"


def token_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each token begins, and its row: runs between white space, in pieces of ``TOKEN_BYTES`` bytes at most, of whole characters."""
    s, e, row = word_spans(buf, offs)
    count = -(-(e - s) // TOKEN_BYTES)
    if len(s) and count.max() > 1:
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        s, row = np.repeat(s, count) + nth * TOKEN_BYTES, np.repeat(row, count)
        for _ in range(3):  # back to a character's first byte
            s = s - ((buf[s] & 0xC0) == 0x80)
    return s, row


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each ``index`` below ``size`` goes under the pseudorandom permutation of its ``key``.

    Four Feistel rounds over the smallest a x b grid of near-equal sides that holds ``size``; places
    beyond it walk on along their cycle, which makes the map a bijection of 0..size-1.
    """
    out = index.astype(np.int64, copy=True)
    size = size.astype(np.int64)
    a = np.ceil(np.sqrt(size)).astype(np.int64)
    a = np.maximum(np.where(a * a < size, a + 1, a), 1)
    b = np.maximum(-(-size // a), 1)
    live = np.arange(len(out))
    while len(live):
        x, aa, bb, k = out[live], a[live], b[live], key[live].astype(np.uint64)
        left, right = x % aa, x // aa
        for r in range(4):
            salt = np.uint64(0xA0761D6478BD642F * (r + 1) & (2**64 - 1))
            if r % 2 == 0:
                left = (left + (mix64(right.astype(np.uint64) ^ mix64(k + salt)) % aa.astype(np.uint64)).astype(np.int64)) % aa
            else:
                right = (right + (mix64(left.astype(np.uint64) ^ mix64(k + salt)) % bb.astype(np.uint64)).astype(np.int64)) % bb
        y = right * aa + left
        out[live] = y
        live = live[y >= size[live]]
    return out


def source_key(sources: list[str], epoch: np.ndarray, seed: int) -> np.ndarray:
    base = {s: np.frombuffer(hashlib.blake2b(s.encode(), digest_size=8).digest(), np.uint64)[0] for s in set(sources)}
    return mix64(np.array([base[s] for s in sources], np.uint64) + mix64(epoch.astype(np.uint64) + np.uint64(seed)))


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text", 2 << 20):
        _, row = token_spans(*text_buffer(b.column("text")))
        n = np.bincount(row, minlength=b.num_rows) if len(row) else np.zeros(b.num_rows, np.int64)
        yield pa.record_batch([b.column("src"), b.column("bucket"), pa.array(n.astype(np.int64))], names=["src", "bucket", "n"])


def _cut(block_tokens: int):
    """Cut the rows, which come in order within each (src, bucket), to pieces of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for b in pieces(batches, "text", 2 << 20):
            buf, offs = text_buffer(b.column("text"))
            s, row = token_spans(buf, offs)
            cuts = np.searchsorted(row, np.arange(b.num_rows + 1))
            # a token runs to the start of the next one, so the white space between stays
            stop = np.append(s[1:], 0)
            src, bucket, base, lang = (b.column(c).to_pylist() for c in ("src", "bucket", "base", "lang"))
            raw = buf.tobytes()
            out: list[tuple] = []
            for i in range(b.num_rows):
                if now != (src[i], bucket[i]):
                    now, at = (src[i], bucket[i]), base[i]
                lo, hi = int(cuts[i]), int(cuts[i + 1])
                while lo < hi:
                    k = min(hi, lo + block_tokens - at % block_tokens)
                    end = int(stop[k - 1]) if k < hi else int(offs[i + 1])
                    out.append((src[i], at // block_tokens, at % block_tokens, k - lo, raw[s[lo] : end].decode().rstrip("\n\r\t ") if k == hi else raw[s[lo] : end].decode(), k == hi, lang[i]))
                    at += k - lo
                    lo = k
            if out:
                cols = list(zip(*out))
                yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.bool_()), pa.array(cols[6], pa.string())], names=["src", "block", "at", "n", "piece", "ends", "lang"])

    return run


def _draw(shares: dict[str, float], per_shard: int, total: int, seed: int):
    names = sorted(shares)
    p = np.array([shares[s] for s in names], np.float64)
    p /= p.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = b.column(0).to_numpy()
            size = np.minimum(per_shard, total - shard * per_shard)
            counts = np.array([np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, 0, int(k)])).multinomial(int(n), p) for k, n in zip(shard, size)], np.int64).reshape(len(shard), len(names))
            yield pa.record_batch([pa.array(np.repeat(shard, len(names))), pa.array(names * len(shard), pa.string()), pa.array(counts.ravel())], names=["shard", "src", "n"])

    return run


def _slots(sizes: dict[str, int], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src = b.column("src").to_pylist()
            nth = b.column("nth").to_numpy()
            size = np.array([sizes[s] for s in src], np.int64)
            epoch = nth // np.maximum(size, 1)
            block = permuted(nth % np.maximum(size, 1), size, source_key(src, epoch, seed))
            yield pa.record_batch([b.column("shard"), b.column("slot"), b.column("src"), pa.array(block)], names=["shard", "slot", "src", "block"])

    return run


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = TEMPERATURE,
    block_tokens: int = BLOCK_TOKENS,
    blocks_per_shard: int = BLOCKS_PER_SHARD,
    seed: int = SEED,
) -> DataFrame:
    """Fixed-length blocks drawn from the sources by weight: ``(shard, slot, source, block, n_tokens, lang, text)``.

    Each source's documents, in a pseudorandom but fixed order, form one stream of tokens (runs between white space, in
    pieces of 16 bytes at most, so that text without white space is counted and cut by its length), cut to blocks of ``block_tokens``; a source's last block may be shorter. As many blocks as
    there are go out, ``blocks_per_shard`` to a shard. A shard's counts by source are one multinomial
    draw with the target weights (by default tokens ** temperature; sources without a weight or with 0 are left out);
    the nth use of a source takes block perm(nth) of its own permutation, which is drawn anew whenever
    the source starts over, so no block comes a second time before all others came once.

    White space within a document stays, a blank line parts documents. Documents without tokens (null,
    empty, blank) add nothing. A null source is a source of its own, named "". ``lang`` is that of most
    of a block's tokens (of equal ones, the first in alphabetical order; null if none is known). Repeated rows count each time.

    The driver holds a number for each source. The text is shuffled twice: to order it within a source's
    buckets of about 4096 documents, and to join a block's parts with the slots. A hot source is cut
    into many buckets and blocks, so no task holds a source.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("source", F.lit("")).alias("src"), F.col("doc_id").cast("long").alias("id"), "lang", "text").where("text is not null")
    n_docs = rows.count()
    buckets = max(1, math.ceil(n_docs / DOCS_PER_BUCKET))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(buckets)))
    counted = rows.select("src", "bucket", "text").mapInArrow(tidy(_count_tokens), "src string, bucket long, n long")
    sums = written(counted.groupBy("src", "bucket").agg(F.sum("n").alias("n")))
    sizes = {r[0]: int(r[1]) for r in sums.groupBy("src").agg(F.sum("n")).collect() if r[1]}
    blocks = {s: -(-n // block_tokens) for s, n in sizes.items()}
    shares = {s: float(weights.get(s, 0.0)) if weights is not None else n**temperature for s, n in sizes.items()}
    shares = {s: w for s, w in shares.items() if w > 0}
    total = sum(blocks.values()) if shares else 0
    if not total:
        return spark.createDataFrame([], "shard long, slot long, source string, block long, n_tokens long, lang string, text string")
    shards = -(-total // blocks_per_shard)
    # slots of the shards
    draws = spark.range(0, shards).mapInArrow(tidy(_draw(shares, blocks_per_shard, total, seed)), "shard long, src string, n long")
    by_source = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    by_shard = Window.partitionBy("shard").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    draws = draws.withColumn("nth0", F.coalesce(F.sum("n").over(by_source), F.lit(0))).withColumn("slot0", F.coalesce(F.sum("n").over(by_shard), F.lit(0)))
    one = draws.where("n > 0").select("shard", "src", "nth0", "slot0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    slots = one.select("shard", (F.col("slot0") + F.col("j")).alias("slot"), "src", (F.col("nth0") + F.col("j")).alias("nth"))
    slots = slots.mapInArrow(tidy(_slots(blocks, seed)), "shard long, slot long, src string, block long")
    # blocks
    w = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("src", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    placed = rows.where(F.col("src").isin(list(shares))) if len(shares) < len(sizes) else rows
    placed = placed.join(bases.hint("shuffle_hash"), ["src", "bucket"]).sortWithinPartitions("src", "bucket", "id", F.xxhash64("text"))
    parts = placed.select("src", "bucket", "base", "lang", "text").mapInArrow(tidy(_cut(block_tokens)), "src string, block long, at int, n int, piece string, ends boolean, lang string")
    parts = parts.groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("at", "n", "piece", "ends", "lang"))).alias("p"))
    text = F.aggregate("p", F.lit(""), lambda acc, x: F.concat(acc, x["piece"], F.when(x["ends"], JOINT).otherwise("")))
    langs = F.array_sort(F.array_distinct(F.filter(F.transform("p", lambda x: x["lang"]), lambda x: x.isNotNull())))
    tally = F.transform(langs, lambda l: F.struct((-F.aggregate("p", F.lit(0), lambda acc, x: acc + F.when(x["lang"] == l, x["n"]).otherwise(0))).alias("c"), l.alias("l")))
    made = parts.select("src", "block", F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("n_tokens"), F.array_min(tally)["l"].alias("lang"), F.regexp_replace(text, "[\\n]+$", "").alias("text"))
    return made.join(slots.hint("shuffle_merge"), ["src", "block"]).select("shard", "slot", F.col("src").alias("source"), "block", "n_tokens", "lang", "text")


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, blocks_per_shard: int = BLOCKS_PER_SHARD, **options) -> DataFrame:
    """``mix_sources`` with the columns of documents: a block's id is its place in the mixture, shard by shard."""
    types = dict(docs.dtypes)
    out = mix_sources(docs, weights, blocks_per_shard=blocks_per_shard, **options)
    out = out.select((F.col("shard") * blocks_per_shard + F.col("slot")).alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    return out.select(*[F.col(c).cast(types.get(c, "string")).alias(c) for c in DOC_COLUMNS])


def op3_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))
