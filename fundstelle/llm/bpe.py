"""Byte-level BPE: exact parallel encoding of long texts by tree concatenation, and decoding."""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, list_array, pieces, text_buffer, tidy
from .piecewise import PieceIds, split

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 1 << 15
LEAF_BYTES = 1 << 11
WINDOW = 8
#: "'re" is one piece where "'" and "r" would be two.
AHEAD = 2


class Codec:
    """One vocabulary: ``encode`` as the library does, and the joins that make halves equal to the whole."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.enc = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.scan = regex.compile(pattern)
        self.known = PieceIds() if pattern == PATTERN else None

    def encode(self, text: str) -> list[int]:
        return self.enc.encode_ordinary(text)

    def _encode_bytes(self, text: bytes) -> list[int]:
        return self.encode(text.decode())

    def decode(self, ids: list[int]) -> str:
        return self.enc.decode_bytes(ids).decode("utf-8", errors="replace")

    def encode_rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and their number in each, equal to ``encode`` of every text."""
        if self.known is None:
            lists = [self.encode(t or "") for t in texts.to_pylist()]
            return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)
        texts.validate(full=True)
        buf, offs = text_buffer(texts)
        start, whole = split(buf, offs)
        first = np.searchsorted(start, offs)
        ids, counts = self.known(buf, start, np.append(start[1:], len(buf)), np.repeat(whole, np.diff(first)), self.encode_piece, self._encode_bytes)
        return ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[first])

    # -- one stretch of bytes that the pattern doesn't split
    def _direct(self, piece: bytes) -> list[int]:
        return self.enc._core_bpe.encode_single_piece(piece) if piece else []

    def encode_piece(self, piece: bytes) -> list[int]:
        """Encode halves of a long piece and join them, down to leaves that are encoded at once."""
        if len(piece) <= LEAF_BYTES:
            return self._direct(piece)
        half = len(piece) // 2
        return self.join_piece(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def join_piece(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two encoded stretches taken as one.

        The tokens within a window around the join are encoded again, and the window doubles until its
        outermost tokens come out as they were on both sides: then each pair of neighbours is one
        that BPE leaves alone, which holds of the encoding of the whole and of no other.
        """
        if not a or not b:
            return a + b
        w = WINDOW
        while True:
            left, right = a[-w:], b[:w]
            mid = self._direct(b"".join(map(self.bytes_of.__getitem__, left + right)))
            at_left = len(left) == len(a) or (len(mid) > 1 and mid[0] == left[0])
            at_right = len(right) == len(b) or (len(mid) > 1 and mid[-1] == right[-1])
            if at_left and at_right:
                return a[: len(a) - len(left)] + mid + b[len(right) :]
            w *= 2

    # -- whole texts
    def leaf(self, text: str) -> Leaf:
        """Encode one part of a longer text, with the places where the pattern splits it."""
        if self.known is not None and text:
            buf = np.frombuffer(text.encode(), np.uint8)
            start, whole = split(buf, np.array([0, len(buf)]))
            if not whole[0]:
                end = np.append(start[1:], len(buf))
                found, n = self.known(buf, start, end, np.zeros(len(start), bool), self.encode_piece, self._encode_bytes)
                chars = end - np.cumsum(buf & 0xC0 == 0x80)[end - 1]
                return Leaf(text, found.tolist(), chars.tolist(), np.cumsum(n).tolist())
        ids: list[int] = []
        ends, counts = [], []
        for m in self.scan.finditer(text):
            ids += self.encode_piece(m.group().encode())
            ends.append(m.end())
            counts.append(len(ids))
        return Leaf(text, ids, ends, counts)

    def join(self, a: Leaf, b: Leaf) -> Leaf:
        """The encoding of two neighbouring parts as one text.

        The pattern looks ``AHEAD`` characters past a piece at most, so those of ``a`` that end so far from
        its end are final. From the last one's end the text is split anew, in a window that doubles until a piece ends
        where one of ``b``'s does, short of the window's own end; from there on ``b`` is right.
        """
        if not a.text or not b.text:
            return b if not a.text else a
        keep = min(len(a.ends) - 1, bisect.bisect_right(a.ends, len(a.text) - AHEAD))
        start = a.ends[keep - 1] if keep > 0 else 0
        token0 = a.counts[keep - 1] if keep > 0 else 0
        tail = a.text[start:]
        b_ends = b.ends
        width = 64
        while True:
            window = tail + b.text[:width]
            whole = width >= len(b.text)
            fresh: list[int] = []
            met = -1
            for m in self.scan.finditer(window):
                if m.end() > len(window) - AHEAD and not whole:
                    break
                fresh.append(m.end())
                in_b = m.end() - len(tail)
                if in_b > 0:
                    k = bisect.bisect_left(b_ends, in_b)
                    # the next piece of b must have been found under the same look-ahead
                    if k < len(b_ends) and b_ends[k] == in_b:
                        met = k
                        break
            if met >= 0 or whole:
                break
            width *= 2
        ids, ends, counts = a.ids[:token0], a.ends[:keep] if keep > 0 else [], a.counts[:keep] if keep > 0 else []
        at = 0
        for end in fresh:
            piece = window[at:end]
            if at == 0 and keep == len(a.ends) - 1 and end == len(tail) + b_ends[0]:  # the last piece of a and the first of b are one
                ids = ids + self.join_piece(a.ids[token0:], b.ids[: b.counts[0]])
            else:
                ids = ids + self.encode_piece(piece.encode())
            ends = ends + [start + end]
            counts = counts + [len(ids)]
            at = end
        if met >= 0:
            shift_t, shift_c = len(ids) - b.counts[met], len(a.text)
            ids = ids + b.ids[b.counts[met] :]
            ends = ends + [e + shift_c for e in b_ends[met + 1 :]]
            counts = counts + [c + shift_t for c in b.counts[met + 1 :]]
        return Leaf(a.text + b.text, ids, ends, counts)

    def join_all(self, leaves: list[Leaf]) -> Leaf:
        """Join neighbours pairwise, level by level."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else Leaf("", [], [], [])


@dataclass
class Leaf:
    text: str
    ids: list[int]
    ends: list[int] = field(default_factory=list)  # of the pieces, in characters
    counts: list[int] = field(default_factory=list)  # tokens up to each end


_CODECS: dict[str, Codec] = {}


def codec(path: str = VOCABULARY) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _ids_array(lists: list[list[int]]) -> pa.Array:
    flat = np.concatenate([np.asarray(x, np.int32) for x in lists]) if lists else np.zeros(0, np.int32)
    return list_array(flat, np.array([len(x) for x in lists], np.int64), pa.int32())


def _encode_short(path: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in pieces(batches, "text", 2 << 20):
            ids, counts = c.encode_rows(b.column("text"))
            same: list[bool | None] = [None] * b.num_rows
            if check:
                ends = np.cumsum(counts)
                same = [c.decode(ids[e - n : e].tolist()) == t for e, n, t in zip(ends.tolist(), counts.tolist(), b.column("text").to_pylist())]
            yield pa.record_batch([b.column("doc_id"), list_array(ids, counts, pa.int32()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "round_trip"])

    return run


def _encode_leaves(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in pieces(batches, "part", 2 << 20):
            made = [c.leaf(t) for t in b.column("part").to_pylist()]
            ints = lambda name: _ids_array([getattr(x, name) for x in made])  # noqa: B023, E731
            yield pa.record_batch([b.column("doc_id"), b.column("tie"), b.column("copies"), b.column("k"), b.column("part"), ints("ids"), ints("ends"), ints("counts")], names=["doc_id", "tie", "copies", "k", "part", "ids", "ends", "counts"])

    return run


def _join_leaves(path: str, check: bool):
    def run(table: pa.Table) -> pa.Table:
        c = codec(path)
        table = table.sort_by("k").combine_chunks()
        lists = [[x.values.to_numpy().tolist() for x in table.column(name)] for name in ("ids", "ends", "counts")]
        whole = c.join_all([Leaf(*x) for x in zip(table.column("part").to_pylist(), *lists)])
        n, doc_id = table.column("copies")[0].as_py(), table.column("doc_id")[0].as_py()
        same = c.decode(whole.ids) == whole.text if check else None
        return pa.table({"doc_id": pa.array([doc_id] * n, pa.int64()), "ids": _ids_array([whole.ids] * n), "round_trip": pa.array([same] * n, pa.bool_())})

    return run


def encode(docs: DataFrame, path: str = VOCABULARY, leaf_chars: int = LEAF_CHARS, check: bool = True) -> DataFrame:
    """``(doc_id, ids, round_trip)`` for every row: what the library gives for the whole text, and, with ``check``, whether decoding gives the text again.

    Texts of up to ``leaf_chars`` characters are encoded where they are read, without a shuffle. Longer ones are
    cut to leaves, which are encoded in parallel on any executor, and joined again pairwise: around
    each join growing windows are encoded anew until both sides agree. Stretches without a split are
    halved in the same way within a leaf. The vocabulary file is read once in each worker.

    Null and empty texts give an empty list. Null ids and repeated rows are kept.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # one scan for each kind: which rows are long is seen from the length alone
    short = rows.where(F.length("text") <= leaf_chars).mapInArrow(tidy(_encode_short(path, check)), "doc_id long, ids array<int>, round_trip boolean")
    long = rows.where(F.length("text") > leaf_chars).withColumn("tie", F.xxhash64("text")).groupBy("doc_id", "tie", "text").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / leaf_chars).cast("int"))
    leaves = long.select("doc_id", "tie", "copies", F.posexplode(F.transform(starts, lambda i: F.substring("text", i * leaf_chars + 1, F.lit(leaf_chars)))).alias("k", "part"))
    spread = leaves.repartition(F.col("doc_id"), F.col("tie"), F.col("k"))
    done = spread.mapInArrow(tidy(_encode_leaves(path)), "doc_id long, tie long, copies int, k int, part string, ids array<int>, ends array<int>, counts array<int>")
    whole = done.groupBy("doc_id", "tie").applyInArrow(_join_leaves(path, check), "doc_id long, ids array<int>, round_trip boolean")
    return short.unionByName(whole)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null and empty lists give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def token_count(ids: Column | str) -> Column:
    return F.size(ids).cast("long")


def op4_bpe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir)).select("doc_id", token_count("ids").alias("n_tokens"), "ids", "round_trip")
