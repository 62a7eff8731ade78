"""Document versions compared by invertible Bloom lookup sketches of their paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, mix64, tidy

CELLS = 32
HASHES = 3
MAX_KEYS = 1 << 18


def _places(keys: np.ndarray, cells: int, salt: int) -> np.ndarray:
    """Three cells for each key, one in each third of the sketch."""
    third = cells // HASHES
    out = np.empty((HASHES, len(keys)), np.int64)
    for h in range(HASHES):
        x = mix64(keys ^ mix64(np.array([salt * HASHES + h + 1], np.uint64)))
        out[h] = (x % np.uint64(third)).astype(np.int64) + h * third
    return out


def sketch(keys: np.ndarray, owner: np.ndarray, owners: int, cells: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sketches of many key sets at once: counts, XOR of keys and XOR of key checksums, ``owners * cells`` each."""
    count = np.zeros(owners * cells, np.int64)
    xor = np.zeros(owners * cells, np.uint64)
    check = np.zeros(owners * cells, np.uint64)
    sums = mix64(keys + np.uint64(0x5851F42D4C957F2D))
    for place in _places(keys, cells, salt):
        at = owner * cells + place
        np.add.at(count, at, 1)
        np.bitwise_xor.at(xor, at, keys)
        np.bitwise_xor.at(check, at, sums)
    return count, xor, check


def subtract(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2]


def peel(diff: tuple[np.ndarray, np.ndarray, np.ndarray], owners: int, cells: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Take out keys of cells that hold just one, until none is left.

    Returns owner, key and sign (+1: only in the first) of what was recovered, and for each owner
    whether its sketch came out empty, which is when its list is complete.
    """
    count, xor, check = diff
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.flatnonzero((count != 0) | (xor != 0))
    rounds = 0
    while len(live) and rounds < 4 * cells + 16:
        rounds += 1
        one = live[np.abs(count[live]) == 1]
        one = one[mix64(xor[one] + np.uint64(0x5851F42D4C957F2D)) == check[one]]
        if not len(one):
            break
        own, key, sign = one // cells, xor[one], count[one]
        order = np.lexsort((key, own))
        own, key, sign = own[order], key[order], sign[order]
        first = np.ones(len(own), bool)
        first[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        own, key, sign = own[first], key[first], sign[first]
        found.append((own, key, sign))
        sums = mix64(key + np.uint64(0x5851F42D4C957F2D))
        touched = []
        for place in _places(key, cells, salt):
            at = own * cells + place
            np.subtract.at(count, at, sign)
            np.bitwise_xor.at(xor, at, key)
            np.bitwise_xor.at(check, at, sums)
            touched.append(at)
        live = np.unique(np.concatenate(touched))
        live = live[(count[live] != 0) | (xor[live] != 0)]
    rest = np.flatnonzero((count != 0) | (xor != 0) | (check != 0))
    done = np.ones(owners, bool)
    done[rest // cells] = False
    if not found:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, done
    own, key, sign = (np.concatenate(x) for x in zip(*found))
    return own, key, sign, done


def differences(old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], owners: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, digest and sign (-1: only in the old version) of every difference, and each owner's cells.

    ``old`` and ``new`` are (owner, digest) arrays of distinct digests. Pairs whose peeling fails try
    again with twice the cells and other hashes.
    """
    size = np.zeros(owners, np.int64)
    todo = np.arange(owners)
    (oo, ok), (no, nk) = old, new
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    salt = 0
    while len(todo):
        cells = -(-cells // HASHES) * HASHES
        place = np.full(owners, -1, np.int64)
        place[todo] = np.arange(len(todo))
        a, b = place[no] >= 0, place[oo] >= 0
        new_sketch = sketch(nk[a], place[no[a]], len(todo), cells, salt)
        old_sketch = sketch(ok[b], place[oo[b]], len(todo), cells, salt)
        own, key, sign, done = peel(subtract(new_sketch, old_sketch), len(todo), cells, salt)
        good = done[own]
        out.append((todo[own[good]], key[good], sign[good]))
        size[todo[done]] = cells
        todo = todo[~done]
        cells, salt = 2 * cells, salt + 1
    own, key, sign = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return own, key, sign, size


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Owner and digest of every element of a list column."""
    counts = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(col)), counts), col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _joined(own: np.ndarray, key: np.ndarray, owners: int) -> list[str]:
    order = np.lexsort((key, own))
    own, key = own[order], key[order]
    cuts = np.searchsorted(own, np.arange(owners + 1))
    hexes = [f"{k:015x}" for k in key.tolist()]
    return [",".join(hexes[cuts[i] : cuts[i + 1]]) for i in range(owners)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        lens = (whole.column("old").value_lengths().fill_null(0).to_numpy(zero_copy_only=False) + whole.column("new").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = np.cumsum(lens)
        at = 0
        while at < whole.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + MAX_KEYS, side="right")))
            b = whole.slice(at, to - at)
            at = to
            n = b.num_rows
            own, key, sign, size = differences(_flat(b.column("old")), _flat(b.column("new")), n)
            more, less = sign > 0, sign < 0
            yield pa.record_batch(
                [
                    b.column("doc_id"),
                    b.column("prev_id"),
                    pa.array(_joined(own[less], key[less], n), pa.string()),
                    pa.array(_joined(own[more], key[more], n), pa.string()),
                    pa.array(np.bincount(own[less], minlength=n), pa.int64()),
                    pa.array(np.bincount(own[more], minlength=n), pa.int64()),
                ],
                names=["doc_id", "prev_id", "removed", "added", "n_removed", "n_added"],
            )


def version_differences(docs: DataFrame) -> DataFrame:
    """What each document changed in the version before it.

    Documents that open with the same non-blank paragraph are versions of one text, in the order of
    their ids (equal ids: of their texts); paragraphs are the lines that aren't blank. Each document's set of 60-bit
    paragraph digests is hashed into a sketch; the sketches of neighbouring versions are subtracted and
    peeled. A failed peel is repeated with twice the cells until it is exact, so long lists work too.

    Returns ``(doc_id, prev_id, removed, added, n_removed, n_added)``: comma-separated hexadecimal
    digests in order, "" where there are none. The first version has a null ``prev_id`` and all its
    paragraphs as added. Documents without a paragraph (null, empty or blank text) and rows of null
    id are left out. Repeated rows follow each other with no differences.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    digest = lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.array_distinct(F.transform(lines, digest)).alias("new"))
    rows = rows.where(F.size("new") > 0).withColumn("title", F.col("new")[0])
    w = Window.partitionBy("title").orderBy("doc_id", "tie")
    rows = rows.select("doc_id", F.lag("doc_id").over(w).alias("prev_id"), F.coalesce(F.lag("new").over(w), F.array().cast("array<bigint>")).alias("old"), "new")
    return rows.mapInArrow(tidy(_compare), "doc_id long, prev_id long, removed string, added string, n_removed long, n_added long")


def op2_paragraph_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_differences(documents(spark, sf_dir))


OP2_SQL = """
with lines as (
  select doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') as ps
  from documents where doc_id is not null and text is not null),
digests as (
  select doc_id, text, list_transform(ps, lambda x: substr(md5(x), 1, 15)) as ds from lines where len(ps) > 0),
versions as (
  select doc_id, list_distinct(ds) as new, row_number() over w as n,
    lag(doc_id) over w as prev_id, coalesce(list_distinct(lag(ds) over w), []) as old
  from digests window w as (partition by ds[1] order by doc_id)),
diff as (
  select doc_id, prev_id,
    list_sort(list_filter(old, lambda x: not list_contains(new, x))) as less,
    list_sort(list_filter(new, lambda x: not list_contains(old, x))) as more
  from versions)
select doc_id, prev_id, array_to_string(less, ',') as removed, array_to_string(more, ',') as added,
  cast(len(less) as bigint) as n_removed, cast(len(more) as bigint) as n_added
from diff
"""
