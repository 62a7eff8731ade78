"""Shared plumbing: shared-folder tables, bounded samples, and byte-level NumPy kernels over Arrow buffers.

The kernels see text as UTF-8 bytes of a whole Arrow batch at once, so the per-row cost is a few
vectorised passes instead of a Python loop.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
DOC_COLUMNS = DOC_SCHEMA.names


# -- Spark side
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names.

    Where that is unset, a local master gets a temporary folder of this process; on a cluster it is an error, as
    executors of other machines couldn't read each other's local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='corpus-')}")
    return f"{root.rstrip('/')}/tables/{uuid.uuid4().hex}"


_LOCAL: dict[str, str] = {}


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them back."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._shared_path = path  # type: ignore[attr-defined]
    return back


def release(df: DataFrame | None) -> None:
    """Delete a table made by ``written`` that nothing will read again."""
    path = getattr(df, "_shared_path", None)
    if path:
        jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)


def bounded_sample(df: DataFrame, by: str, id_col: str, per_class: int, seed: int = 7) -> DataFrame:
    """At most ``per_class`` rows of each value of ``by``, for fitting a model.

    A hash threshold taken from the class counts leaves about twice the bound, whatever the table's
    size; only those few rows are ranked. Rows where ``by`` or the id is null are left out.
    """
    slot = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30))
    rows = df.where(F.col(by).isNotNull() & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    if not counts:
        return rows.limit(0)
    cut = F.lit(0).cast("long")
    for value, n in sorted(counts.items(), key=str):
        share = min(1.0, (2.0 * per_class + 40) / n)
        cut = F.when(F.col(by) == F.lit(value), F.lit(int(share * (1 << 30)))).otherwise(cut)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(by).orderBy(slot, F.col(id_col)))
    return rows.where(slot < cut).withColumn("__rank", rank).where(F.col("__rank") <= per_class).drop("__rank")


def small(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """A written table of narrow rows, broadcast if it has ``rows`` at most; joins shuffle beyond it."""
    return F.broadcast(df) if df.count() <= rows else df


def summed(df: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``fn``'s float arrays of ``size`` over all batches: by partition, then by 64 groups, then here."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += fn(b).ravel()
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"s": pa.array([np.sum([np.frombuffer(x) for x in table.column("s").to_pylist()], axis=0).tobytes()], pa.binary())})

    parts = df.mapInArrow(tidy(partial), "s binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(64)))
    rows = parts.groupBy("g").applyInArrow(merge, "s binary").collect()
    return np.sum([np.frombuffer(r[0]) for r in rows], axis=0) if rows else np.zeros(size)


# -- Arrow and bytes
def tidy(fn: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """Give a task's freed memory back to the system when it ends: Spark keeps its Python workers for later tasks."""

    @functools.wraps(fn)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            for key in _POW:
                _POW[key] = np.ones(1, np.uint64)
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its n+1 offsets, starting at 0; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    n = len(arr)
    if off is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], col: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut the batches so that each holds about ``max_bytes`` of text at most, or one row."""
    for b in batches:
        if b.num_rows == 0:
            continue
        _, offs = text_buffer(b.column(col))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + max_bytes, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to


def lower_bytes(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the two-byte Latin-1 letters; lengths stay."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    if len(buf) > 1:
        two = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        out[two] += 32
    return out


def _lower_table() -> np.ndarray:
    low = np.arange(1 << 16, dtype=np.uint32)
    for i in range(0xD800):
        x = chr(i).lower()
        if len(x) == 1:
            low[i] = ord(x)
    return low


LOWER = _lower_table()


def code_points(arr: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string array and its n+1 offsets in them; with ``fold`` in lower case, where that is one code point of the BMP."""
    buf, offs = text_buffer(arr)
    try:
        cps = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        offs = offs - np.searchsorted(np.flatnonzero((buf & 0xC0) == 0x80), offs)
    except UnicodeDecodeError:  # damaged rows count with replacement characters
        texts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:])]
        cps = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    if fold and len(cps):
        cps = LOWER[cps] if cps.max() < 1 << 16 else np.where(cps < 1 << 16, LOWER[np.minimum(cps, 0xFFFF)], cps)
    return cps, offs


_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["p"]) < n:
        m = max(n, 1 << 16)
        for key, base in (("p", _P), ("i", _PINV)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _POW[key] = np.multiply.accumulate(a)
    return _POW["p"], _POW["i"]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hasher:
    """Position-independent 64-bit hashes of any byte ranges of one buffer, from one prefix sum."""

    def __init__(self, buf: np.ndarray):
        p, self.inv = _powers(len(buf) + 1)
        self.sum = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=self.sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sum[end] - self.sum[start]) * self.inv[start] + (end - start).astype(np.uint64))


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the white-space separated words, and each one's row."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = buf > 32
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    start[cuts[solid[cuts]]] = True
    end[cuts[solid[cuts - 1]] - 1] = True
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, side="right") - 1


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))
