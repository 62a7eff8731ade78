"""Token ids as length-delimited binary records with masked checksums, and an offset index."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import VOCABULARY, encode
from .common import documents, shared_dir, tidy

MAX_FILE_BYTES = 256 << 20
#: Ids that are framed at once: their checksums' arrays take about 50 bytes for each byte of data.
MAX_IDS = 1 << 18
MASK_DELTA = 0xA282EAD8
_CHUNK = 128
INDEX = "doc_id long, file string, offset long, length long, n_tokens long, checksum long"


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    return t


_T = _table()


def _zeros_table(n: int) -> np.ndarray:
    """The state after ``n`` zero bytes, for each byte of the state: four tables of 256."""
    s = (np.arange(256, dtype=np.uint32)[None] << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
    for _ in range(n):
        s = _T[s & 0xFF] ^ (s >> np.uint32(8))
    return s


_Z = _zeros_table(_CHUNK)


def crc32c(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """CRC-32C of each byte range, all of them 4 bytes long or more (shorter ones go one by one).

    Every range is cut to chunks whose checksums advance together, one byte a step; a range's chunks
    are then folded by the table that moves a state past one chunk of zeros.
    """
    lens = np.diff(offs)
    n = len(lens)
    out = np.zeros(n, np.uint32)
    for i in np.flatnonzero(lens < 4):
        s = 0xFFFFFFFF
        for b in buf[offs[i] : offs[i + 1]].tolist():
            s = int(_T[(s ^ b) & 0xFF]) ^ (s >> 8)
        out[i] = s ^ 0xFFFFFFFF
    big = np.flatnonzero(lens >= 4)
    if not len(big):
        return out
    chunks = -(-lens[big] // _CHUNK)
    first = np.zeros(len(big), np.int64)
    np.cumsum(chunks[:-1], out=first[1:])
    flat = np.zeros(int(chunks.sum()) * _CHUNK, np.uint8)
    start = first * _CHUNK + chunks * _CHUNK - lens[big]  # the padding stands in front, where it changes nothing
    at = np.repeat(start - offs[big], lens[big])
    src = np.concatenate([np.arange(offs[i], offs[i + 1]) for i in big]) if len(big) < n else np.arange(offs[0], offs[-1])
    flat[at + src] = buf[src]
    for j in range(4):  # the initial state of ones
        flat[start + j] ^= 0xFF
    m = np.ascontiguousarray(flat.reshape(-1, _CHUNK).T)
    s = np.zeros(m.shape[1], np.uint32)
    for j in range(_CHUNK):
        s = _T[(s ^ m[j]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    order = np.argsort(-chunks, kind="stable")
    c, f = chunks[order], first[order]
    state = s[f].copy()
    for k in range(1, int(c[0])):
        na = int(np.searchsorted(-c, -k, side="left"))
        x = state[:na]
        state[:na] = _Z[0][x & 0xFF] ^ _Z[1][(x >> np.uint32(8)) & 0xFF] ^ _Z[2][(x >> np.uint32(16)) & 0xFF] ^ _Z[3][x >> np.uint32(24)] ^ s[f[:na] + k]
    out[big[order]] = state ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated by 15 and shifted by a constant, so that checksums of data that hold checksums stay sound."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frames(ids: np.ndarray, counts: np.ndarray, doc_id: np.ndarray, width: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Framed records, their lengths with frame, and the data checksums.

    A record is the length of its data (8 bytes, little-endian), that length's masked checksum (4), the
    data and its masked checksum (4). The data are the document id (8) and the ids, ``width`` bytes each.
    """
    n = len(counts)
    lens = 8 + counts * width
    offs = np.zeros(n + 1, np.int64)
    np.cumsum(lens + 16, out=offs[1:])
    out = np.zeros(int(offs[-1]), np.uint8)

    def put(start: np.ndarray, raw: np.ndarray) -> None:
        out[start[:, None] + np.arange(raw.shape[1])] = raw

    head = lens.astype("<u8").view(np.uint8).reshape(n, 8)
    put(offs[:-1], head)
    put(offs[:-1] + 8, masked(crc32c(head.ravel(), np.arange(n + 1) * 8)).astype("<u4").view(np.uint8).reshape(n, 4))
    put(offs[:-1] + 12, doc_id.astype("<i8").view(np.uint8).reshape(n, 8))
    body = ids.astype(f"<u{width}").view(np.uint8)
    bytes_of = counts * width
    before = np.zeros(n, np.int64)
    np.cumsum(bytes_of[:-1], out=before[1:])
    out[np.arange(len(body)) + np.repeat(offs[:-1] + 20 - before, bytes_of)] = body
    data_offs = np.zeros(n + 1, np.int64)
    np.cumsum(lens, out=data_offs[1:])
    data = out[np.arange(int(data_offs[-1])) + np.repeat(offs[:-1] + 12 - data_offs[:-1], lens)]
    sums = masked(crc32c(data, data_offs))
    put(offs[1:] - 4, sums.astype("<u4").view(np.uint8).reshape(n, 4))
    return out.tobytes(), lens + 16, sums


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the batches so that each holds about ``MAX_IDS`` ids at most, or one row."""
    for b in batches:
        ends = np.cumsum(b.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + MAX_IDS, side="right")))
            yield b.slice(at, to - at)
            at = to


def _writer(uri: str, width: int, max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        stream, name, at = None, "", 0
        try:
            for b in _slices(batches):
                if stream is None or at >= max_bytes:
                    if stream is not None:
                        stream.close()
                    name, at = f"part-{uuid.uuid4().hex}.records", 0  # an attempt's own file: a retry never writes to it
                    stream = fs.open_output_stream(f"{root}/{name}")
                col = b.column("ids")
                counts = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = col.flatten()
                values = flat.fill_null(0).to_numpy(zero_copy_only=False)
                if len(values) and (values.min() < 0 or int(values.max()) >= 1 << (8 * width)):
                    raise ValueError(f"a token id doesn't fit into {width} bytes")
                raw, lens, sums = frames(values, counts, b.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False), width)
                stream.write(raw)
                offs = at + np.cumsum(lens) - lens
                at += len(raw)
                yield pa.record_batch([b.column("doc_id"), pa.array([name] * b.num_rows), pa.array(offs), pa.array(lens), pa.array(counts), pa.array(sums.astype(np.int64))], names=["doc_id", "file", "offset", "length", "n_tokens", "checksum"])
        finally:
            if stream is not None:
                stream.close()

    return run


def write_records(encoded: DataFrame, uri: str, width: int = 2, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Write ``(doc_id, ids)`` as record files under ``uri`` and return the offset index, a Parquet table beside them.

    Every task writes its own files where its rows are, without a shuffle. The index names the files
    of the attempts that succeeded, so what a lost or repeated attempt left is never read; it is
    deleted at the end. Index: ``(doc_id, file, offset, length, n_tokens, checksum)``, a row for each input
    row. A null or empty list makes a record without ids, a null element is 0, a null id is written as -1 (null in the index).
    An id that doesn't fit ``width`` bytes is an error.
    """
    spark = encoded.sparkSession
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    rows.mapInArrow(tidy(_writer(f"{uri}/data", width, max_file_bytes)), INDEX).write.parquet(f"{uri}/index")
    index = spark.read.schema(INDEX).parquet(f"{uri}/index")
    fs, root = pafs.FileSystem.from_uri(f"{uri}/data")
    good = {r[0] for r in index.select("file").distinct().toLocalIterator()}
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f.base_name not in good:
            fs.delete_file(f.path)
    return index


def parse_record(raw: bytes, width: int = 2) -> tuple[int, np.ndarray]:
    """Document id and ids of one framed record; ValueError if a length or checksum is wrong."""
    (size,), (head,) = struct.unpack_from("<Q", raw), struct.unpack_from("<I", raw, 8)
    if size != len(raw) - 16 or int(masked(crc32c(np.frombuffer(raw, np.uint8, 8), np.array([0, 8])))[0]) != head:
        raise ValueError("the record's length is damaged")
    data = np.frombuffer(raw, np.uint8, size, 12)
    if int(masked(crc32c(data, np.array([0, size])))[0]) != struct.unpack_from("<I", raw, 12 + size)[0]:
        raise ValueError("the record's data are damaged")
    return int(data[:8].view("<i8")[0]), data[8:].view(f"<u{width}")


def read_records(index: DataFrame, uri: str, width: int = 2) -> DataFrame:
    """``(doc_id, ids)`` of the records that ``index`` names, in its order: each is fetched by its offset and checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(f"{uri}/data")
        files: dict[str, pa.NativeFile] = {}
        for b in batches:
            got = []
            for name, off, size in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if name not in files:
                    files[name] = fs.open_input_file(f"{root}/{name}")
                got.append(parse_record(files[name].read_at(size, off), width)[1].astype(np.int32))
            counts = np.array([len(x) for x in got], np.int64)
            offs = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=offs[1:])
            flat = np.concatenate(got) if got else np.zeros(0, np.int32)
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], names=["doc_id", "ids"])

    return index.select("doc_id", "file", "offset", "length").mapInArrow(tidy(run), "doc_id long, ids array<int>")


def op6_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and write all documents; the result is the index."""
    return write_records(encode(documents(spark, sf_dir), VOCABULARY, check=False), shared_dir(spark))
