"""Fuzzy line dedup: MinHash signatures of character shingles, banding, exact Jaccard, union-find."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import code_points, documents, mix64, pieces, release, small, text_buffer, tidy, written
from .components import components

SHINGLE = 5
HASHES = 32
BANDS = 8
ROWS = HASHES // BANDS
JACCARD = 0.8
#: Lines of one band key that are compared in one task; more are cut to blocks, and pairs of blocks meet.
BLOCK_LINES = 2048
#: Lines of a cell up to which cells are compared together.
SMALL_CELL = 64
#: Bits of a line's map of shingles.
MAP_BITS = 8192
#: Lines (16 bytes each) that a task remembers to have sent; beyond it forgets them and sends repeated lines again.
REMEMBERED = 1 << 20
#: Rows (32 bytes each) of band keys that a task holds before it packs them, and that are sorted at once of one bucket.
HELD = 1 << 19
#: Rows of band keys in one packed row at most.
PACKED = 1 << 10
#: Buckets of band keys for each shuffle partition.
BUCKETS = 4
_RNG = np.random.Generator(np.random.PCG64(20240415))
_MIX = _RNG.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _RNG.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


# -- lines and shingles
def _blank(raw: bytes) -> bool:
    text = raw.decode("utf-8", "replace")
    return not text or text.isspace()


def line_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Byte ranges, rows and numbers of all lines (what line feeds part) that hold more than white space of any kind."""
    n = len(offs) - 1
    feeds = np.flatnonzero(buf == 10)
    row_of_feed = np.searchsorted(offs, feeds, side="right") - 1
    some = np.flatnonzero(np.diff(offs) > 0)
    start = np.concatenate([offs[:-1][some], feeds + 1])
    row = np.concatenate([some, row_of_feed])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    same = np.append(row[1:] == row[:-1], False)
    end = np.where(same, np.append(start[1:], 0) - 1, offs[row + 1])
    first = np.searchsorted(row, np.arange(n))
    no = np.arange(len(row)) - first[row]
    keep = end > start
    ascii_sign = np.append(~_SPACES[buf] & (buf < 128), False)
    for i in np.flatnonzero(keep & ~ascii_sign[start] & ~ascii_sign[end - 1]):  # of spaces alone, perhaps of other kinds
        keep[i] = ascii_sign[start[i] : end[i]].any() or not _blank(buf[start[i] : end[i]].tobytes())
    return start[keep], end[keep], row[keep], no[keep]


def digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits for each byte range: (lines, 2) signed 64-bit numbers."""
    view = memoryview(raw)
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist())]), ">i8").astype(np.int64).reshape(-1, 2)


def _strings(raw: bytes, start: np.ndarray, end: np.ndarray) -> pa.Array:
    view, offs = memoryview(raw), np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offs[1:])
    data = b"".join([view[a:b] for a, b in zip(start.tolist(), end.tolist())])
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offs), pa.py_buffer(data)])


def shingle_hashes(arr: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-character windows of each lower-cased line, in order, and the n+1 offsets of the lines; a shorter line is one window."""
    cps, offs = code_points(arr)
    lens = np.diff(offs)
    wide = np.zeros(len(cps) + k - 1, np.uint64)
    wide[: len(cps)] = cps
    h = wide[: len(cps)] * _MIX[0]
    part = np.empty_like(h)
    for j in range(1, k):
        h += np.multiply(wide[j : len(cps) + j], _MIX[j], out=part)
    use = np.ones(len(cps), bool)
    for j in range(1, k):  # windows across a line's end
        use[offs[1:][lens >= j] - j] = False
    for i in np.flatnonzero((lens > 0) & (lens < k)):
        at = offs[i]
        use[at] = True
        h[at] = (wide[at : offs[i + 1]] * _MIX[: lens[i]]).sum(dtype=np.uint64)
    ends = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(np.where(lens > 0, np.maximum(lens - k + 1, 1), 0), out=ends[1:])
    return mix64(h[use]), ends


def signatures(arr: pa.Array) -> np.ndarray:
    """``HASHES`` least values of each line's shingles, each under a permutation of its own; a line without any has ones."""
    h, ends = shingle_hashes(arr)
    sig = np.full((HASHES, len(arr)), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(ends) > 0)
    if len(some):
        low = (h >> np.uint64(32)).astype(np.uint32)
        start = ends[:-1][some]
        for i in range(HASHES):
            sig[i, some] = np.minimum.reduceat(low * _MULTIPLY[i], start)
    return np.ascontiguousarray(sig.T)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    n, hashes = sig.shape
    parts = sig.reshape(n, bands, hashes // bands).astype(np.uint64)
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], n, 0)
    for j in range(parts.shape[2]):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key


def sketches(sig: np.ndarray) -> np.ndarray:
    """Four bits of each of a signature's values: two 64-bit words a line."""
    four = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint64)
    shift = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return np.stack([np.bitwise_or.reduce(four[:, i : i + 16] << shift, axis=1) for i in (0, 16)], axis=1)


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of the 32 places sketches agree; the last axis has their two words."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return HASHES - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int16)


def least_agreements(threshold: float) -> int:
    """Places in which lines of an index of ``threshold`` agree but for one in 100,000 (4.5 standard deviations)."""
    p = threshold + (1 - threshold) / 16
    return math.floor(HASHES * p - 4.5 * math.sqrt(HASHES * p * (1 - p)))


# -- passes over the documents
def _new_lines(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Digests and texts of lines, each about once in a task."""
    seen: set[int] = set()
    for b in pieces(batches, "text", max_bytes):
        buf, offs = text_buffer(b.column("text"))
        start, end, _, _ = line_spans(buf, offs)
        if not len(start):
            continue
        raw = buf.tobytes()
        h = digests(raw, start, end)
        if len(seen) > REMEMBERED:
            seen = set()
        use = []
        for i, x in enumerate(h[:, 0].tolist()):
            if x not in seen:
                seen.add(x)
                use.append(i)
        if use:
            yield h[use], _strings(raw, start[use], end[use])


def _packed(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows (band, h, two words of sketch) as bytes, by the bucket of their band key: the JVM moves and sorts some thousand of them as one."""
    bucket = (rows[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    at = np.concatenate([np.arange(a, b, PACKED) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)])])
    offs = (np.append(at, len(bucket)) * 32).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offs), pa.py_buffer(rows[order])])
    return pa.record_batch([pa.array(bucket[at].astype(np.int32)), data], names=["bucket", "rows"])


def _emit_bands(buckets: int):
    """The rows of all band keys of the lines, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for h, lines in _new_lines(batches, 1 << 17):
            sig = signatures(lines)
            rows = np.empty((len(h), BANDS, 4), np.int64)
            rows[:, :, 0] = band_keys(sig).view(np.int64)
            rows[:, :, 1] = h[:, :1]
            rows[:, :, 2:] = sketches(sig).view(np.int64)[:, None]
            held.append(rows.reshape(-1, 4))
            if sum(map(len, held)) >= HELD:
                yield _packed(np.concatenate(held), buckets)
                held = []
        if held:
            yield _packed(np.concatenate(held), buckets)

    return run


def _emit_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for h, lines in _new_lines(batches, 1 << 20):
        yield pa.record_batch([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), lines], names=["h", "h2", "line"])


def _emit_spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text", 1 << 20):
        buf, offs = text_buffer(b.column("text"))
        start, end, row, no = line_spans(buf, offs)
        if not len(start):
            continue
        h = digests(buf.tobytes(), start, end)
        row = pa.array(row)
        yield pa.record_batch([b.column("id").take(row), b.column("tie").take(row), pa.array(no.astype(np.int32)), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))], names=["id", "tie", "no", "h", "h2"])


# -- candidates and their comparison
def _against_first(rows: np.ndarray, hubs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (band, h, sketch) beside the first one of their band, which is one of the ``hubs`` rows in front or else the one of least ``h``:
    both, without repeated lines, and the first ones of all bands."""
    order = np.argsort(rows[:, 0], kind="stable")
    band = rows[order, 0]
    new = np.append(True, band[1:] != band[:-1])
    alone = new & np.append(new[1:], True)
    some = order[~alone]
    some = some[np.lexsort((rows[some, 1], some >= hubs, rows[some, 0]))]
    part = rows[some]
    other = np.append(True, part[1:, 0] != part[:-1, 0])[: len(part)]
    first = np.flatnonzero(other)
    hub = part[np.repeat(first, np.diff(np.append(first, len(part))))]
    other[1:] |= part[1:, 1] != part[:-1, 1]
    use = other & (part[:, 1] != hub[:, 1])
    return hub[use], part[use], np.concatenate([rows[order[alone]], part[first]])


def _stars(threshold: float):
    """From packed rows, sorted by bucket: each further line of a band beside the band's first one, whether their sketches agree enough, and
    whether the band may have more lines than these two. A task holds one bucket's rows, or ``HELD`` of them and the first one of each band."""
    least = least_agreements(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, hubs, several = None, [], np.zeros((0, 4), np.int64), False

        def judged() -> Iterator[pa.RecordBatch]:
            nonlocal held, hubs
            hub, own, firsts = _against_first(np.concatenate([hubs, *held]), len(hubs))
            held, hubs = [], firsts
            if len(own):
                near = agreements(hub[:, 2:].view(np.uint64), own[:, 2:].view(np.uint64)) >= least
                again = own[1:, 0] == own[:-1, 0]
                more = np.append(again, False) | np.append(False, again) | several
                cols = [own[:, 0], hub[:, 1], own[:, 1], near, own[:, 2], own[:, 3], more]
                yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in cols], names=["band", "hub", "h", "near", "s0", "s1", "more"])

        for b in batches:
            for bucket, raw in zip(b.column("bucket").to_pylist(), b.column("rows")):
                if bucket != now:
                    if held:
                        yield from judged()
                    now, hubs, several = bucket, hubs[:0], False
                held.append(np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, 4))
                if len(held) * PACKED >= HELD and sum(map(len, held)) >= HELD:
                    several = True
                    yield from judged()
        if held:
            yield from judged()

    return run


class _Sets:
    """Shingle sets of some lines, each made when it is first needed, and bit maps of all that rule out most pairs."""

    def __init__(self, lines: pa.Array):
        self.h, self.ends = shingle_hashes(lines)
        self.made: dict[int, frozenset[int]] = {}
        n = len(self.ends) - 1
        self.count = np.diff(self.ends)
        self.maps = np.empty((n, MAP_BITS // 64), np.uint64)
        for at in range(0, n, 256):
            to = min(n, at + 256)
            bits = np.zeros((to - at, MAP_BITS), bool)
            own = self.h[self.ends[at] : self.ends[to]]
            bits[np.repeat(np.arange(to - at), self.count[at:to]), (own & np.uint64(MAP_BITS - 1)).astype(np.int64)] = True
            self.maps[at:to] = np.packbits(bits, axis=1).view(np.uint64)

    def __getitem__(self, i: int) -> frozenset[int]:
        if i not in self.made:
            self.made[i] = frozenset(self.h[self.ends[i] : self.ends[i + 1]].tolist())
        return self.made[i]


def _shingle_sets(lines: pa.Array) -> list[frozenset[int]]:
    sets = _Sets(lines)
    return [sets[i] for i in range(len(lines))]


def may_be_alike(a: _Sets, x: np.ndarray, b: _Sets, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which lines ``x`` of ``a`` and ``y`` of ``b`` their bit maps don't rule out.

    A bit of one map alone stands for a shingle at least that the other line lacks: so many shingles are
    outside of the intersection at least, and what can be inside it bounds the index from above.
    """
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), 1 << 12):
        i, j = x[at : at + (1 << 12)], y[at : at + (1 << 12)]
        p, q = a.maps[i], b.maps[j]
        only_p, only_q = (np.bitwise_count(m).sum(1, dtype=np.int64) for m in (p & ~q, q & ~p))
        both = np.minimum(a.count[i] - only_p, b.count[j] - only_q)
        out[at : at + (1 << 12)] = both >= threshold * np.maximum(1, both + only_p + only_q) - 1e-9
    return out


def _alike(x: frozenset[int], y: frozenset[int], threshold: float) -> bool:
    a, b = len(x), len(y)
    if min(a, b) < threshold * max(a, b):
        return False
    both = len(x & y)
    return both >= threshold * max(1, a + b - both)


def _verify_stars(threshold: float):
    """Exact Jaccard of each pair; the rows are sorted by u, whose shingles are made once for a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for whole in batches:
            for b in pieces(iter([whole]), "tv", 1 << 19):
                sets = _Sets(b.column("tv"))
                u = b.column("u").to_pylist()
                heads = [i for i, x in enumerate(u) if x != (u[i - 1] if i else now)]
                new = np.zeros(len(u), bool)
                new[heads] = True
                hubs = _Sets(b.column("tu").take(pa.array([0, *(i for i in heads if i)], pa.int64())))
                hub = np.cumsum(new) - int(new[0])
                may = may_be_alike(hubs, hub, sets, np.arange(len(u)), threshold).tolist()
                near = [ok and _alike(hubs[x], sets[i], threshold) for i, (x, ok) in enumerate(zip(hub.tolist(), may))]
                now = u[-1]
                yield pa.record_batch([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    return run


def _agreeing(sk: np.ndarray, root: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i > j of different roots whose sketches agree in ``least`` places, some rows at a time."""
    step = max(1, (1 << 19) // len(sk))
    for at in range(0, len(sk), step):
        i = slice(at, at + step)
        ok = agreements(sk[i, None], sk[None, : at + step]) >= least
        ok &= root[i, None] != root[None, : at + step]
        x, y = np.nonzero(ok)
        x += at
        yield x[x > y], y[x > y]


def _pairs(sk: np.ndarray, root: np.ndarray, cell: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for many cells at once, whose rows are beside each other: small ones together, by their distance, and large ones each."""
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    size = np.diff(np.append(first, len(cell)))
    for at, n in zip(first[size > SMALL_CELL].tolist(), size[size > SMALL_CELL].tolist()):
        for x, y in _agreeing(sk[at : at + n], root[at : at + n], least):
            yield x + at, y + at
    rows = np.flatnonzero(np.repeat(size <= SMALL_CELL, size))
    end = np.repeat(first + size, size)
    for d in range(1, int(size[size <= SMALL_CELL].max(initial=1))):
        rows = rows[rows + d < end[rows]]
        near = rows[agreements(sk[rows], sk[rows + d]) >= least]
        near = near[root[near] != root[near + d]]
        yield near + d, near


def joined_within(lines: pa.Array, sk: np.ndarray, roots: np.ndarray, cell: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that join the lines of each cell, whose components are given, as all similar pairs would.

    Only pairs whose sketches agree are compared, and none within a component, also within one that has just been made.
    """
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    own, out = roots.tolist(), []
    sets = _Sets(lines)
    for x, y in _pairs(sk, roots, cell, least_agreements(threshold)):
        may = may_be_alike(sets, x, sets, y, threshold)
        x, y = x[may], y[may]
        for i, j in zip(x.tolist(), y.tolist()):
            a, b = find(own[i]), find(own[j])
            if a != b and _alike(sets[i], sets[j], threshold):
                parent[a] = b
                out.append((i, j))
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole cells (band, block, block), whose rows come together, with sketches, roots and the cells' numbers; about 4096 rows or a megabyte, or one cell."""

    def read(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        col = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
        keys = np.stack([col(c) for c in ("band", "lo", "hi")], axis=1)
        cell = np.cumsum(np.append(0, (keys[1:] != keys[:-1]).any(1)))
        return b, np.stack([col("s0"), col("s1")], axis=1).view(np.uint64), col("root"), cell

    held: list[pa.RecordBatch] = []
    for whole in batches:
        for b in pieces(iter([whole]), "line", 1 << 19) if "line" in whole.schema.names else [whole]:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) >= 4096 or sum(x.nbytes for x in held) >= 1 << 20:
                t, sk, root, cell = read(held)
                cut = int(np.searchsorted(cell, cell[-1]))
                if cut:
                    yield t.slice(0, cut), sk[:cut], root[:cut], cell[:cut]
                held = [t.slice(cut)]
    if held:
        yield read(held)


def _promising(threshold: float):
    """The lines of each cell whose sketch agrees with one of another component's line."""
    least = least_agreements(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sk, root, cell in _cells(batches):
            use = np.zeros(b.num_rows, bool)
            for x, y in _pairs(sk, root, cell, least):
                use[x] = use[y] = True
            if use.any():
                yield b.filter(pa.array(use))

    return run


def _verify_cells(threshold: float):
    """Links across components within each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sk, root, cell in _cells(batches):
            links = joined_within(b.column("line"), sk, root, cell, threshold)
            if links:
                h = b.column("h").to_numpy(zero_copy_only=False)
                yield pa.record_batch([pa.array(h[[i for i, _ in links]]), pa.array(h[[j for _, j in links]])], names=["u", "v"])

    return run


def line_components(docs: DataFrame, threshold: float = JACCARD, block: int = BLOCK_LINES) -> DataFrame:
    """``(h, h2, root)`` for lines, by the 128 bits of their text, that are joined to others by similar text; ``root`` is the ``h`` of one of them.

    Two passes over the candidates find the components of all similar pairs under a common band key without looking at all
    texts: first each line against the first of its band key; then, under keys that hold different components still, lines of different
    components, in blocks of ``block`` lines. Band keys carry sketches of the signatures (16 bytes a line); texts are fetched and compared
    for pairs whose sketches agree as lines of an index of ``threshold`` do but for one in 100,000.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bands = docs.select("text").where("text is not null").mapInArrow(tidy(_emit_bands(BUCKETS * parts)), "bucket int, rows binary")
    members = written(bands.repartitionById(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_stars(threshold)), "band long, hub long, h long, near boolean, s0 long, s1 long, more boolean"))

    def texts_of(h: DataFrame) -> DataFrame:
        lines = docs.select("text").where("text is not null").mapInArrow(tidy(_emit_texts), "h long, h2 long, line string")
        # of lines of equal h (one pair in 2**64) the one of least h2 takes part
        return written(lines.join(small(h), "h", "left_semi").groupBy("h").agg(F.min(F.struct("h2", "line")).alias("x")).select("h", "x.h2", "x.line"))

    stars = written(members.where("near").select(F.col("hub").alias("u"), F.col("h").alias("v")).distinct())
    keys = written(stars.select("u").union(stars.select("v")).toDF("h").distinct())
    texts = texts_of(keys)
    one = stars.join(texts.select(F.col("h").alias("v"), F.col("line").alias("tv")), "v")
    two = one.join(texts.select(F.col("h").alias("u"), F.col("line").alias("tu")), "u").sortWithinPartitions("u")
    edges = written(two.select("u", "v", "tu", "tv").mapInArrow(tidy(_verify_stars(threshold)), "u long, v long"))
    found = components(edges)
    rooted = members.where("more").join(small(found.withColumnRenamed("node", "h")), "h", "left").select("band", "h", F.coalesce("root", "h").alias("root"), "s0", "s1")
    open_bands = rooted.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    blocks = F.ceil(F.col("n") / block).cast("int")
    cells = rooted.join(open_bands.select("band", blocks.alias("blocks")), "band").withColumn("own", F.pmod("h", "blocks").cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "h", "root", "s0", "s1")
    by_cell = lambda df: df.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "h")
    maybe = written(by_cell(cells).mapInArrow(tidy(_promising(threshold)), cells.schema))
    more_keys = written(maybe.select("h").distinct())
    more_texts = texts_of(more_keys)
    more = written(by_cell(maybe.join(more_texts.select("h", "line"), "h")).select(*maybe.columns, "line").mapInArrow(tidy(_verify_cells(threshold)), "u long, v long"))
    if more.limit(1).count():
        again = components(edges.union(more))
        release(found)
        found = again
    names = texts.select("h", "h2").union(more_texts.select("h", "h2")).distinct()
    out = written(found.withColumnRenamed("node", "h").join(names, "h").select("h", "h2", "root"))
    for t in (members, stars, keys, texts, edges, maybe, more_keys, more_texts, more, found):
        release(t)
    return out


def dedup_lines(docs: DataFrame, threshold: float = JACCARD) -> DataFrame:
    """The documents without the lines that repeat an earlier one: ``docs``' columns, ``text`` rewritten.

    Lines are what line feeds part; those of white space alone (of any kind, so also a carriage return or a tab) stay and never match.
    Lines of equal 128 bits are equal. Two lines are similar if the Jaccard index of their sets of lower-cased 5-character shingles (a
    shorter line is one; lower case is by single code points) is ``threshold`` or more; similar lines form components, of which
    the occurrence of least (doc_id, hash of the text, line number) stays. Pairs are found by 8 bands of 4 of 32 MinHash
    values (98.5 % at an index of 0.8, 99.9 % at 0.9) and verified on the whole lines; before that, pairs whose 32 values agree in
    fewer places than lines of that index do but for one in 100,000 are left out.

    A document that loses all its lines stays with an empty text. Null text stays null. Rows of equal id
    and text are one document that occurs twice: they keep the same lines. Null ids are kept and count as least. ``n_chars``, if there, is counted anew.
    """
    found = line_components(docs, threshold)
    ids = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("tie"), "text")
    lines = ids.mapInArrow(tidy(_emit_spots), "id long, tie long, no int, h long, h2 long")
    # a line's group: that of its component, or else its own 128 bits
    lines = lines.join(small(found), ["h", "h2"], "left").select(F.coalesce("root", "h").alias("g"), F.when(F.col("root").isNull(), F.col("h2")).alias("g2"), "id", "tie", "no")
    spots = written(lines.withColumn("g2", F.coalesce("g2", F.lit(0))))
    place = F.struct("id", "tie", "no")
    first = spots.groupBy("g", "g2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    drop = spots.join(first.select("g", "g2", "first"), ["g", "g2"]).where(F.struct("id", "tie", "no") != F.col("first"))
    drop = written(drop.groupBy("id", "tie").agg(F.collect_set("no").alias("__gone")))
    release(spots)
    cols = docs.columns
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("__tie", F.xxhash64("text"))
    out = keyed.join(drop.select(F.col("id").alias("__id"), F.col("tie").alias("__tie"), "__gone"), ["__id", "__tie"], "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)
    out = out.withColumn("text", text)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*cols)


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir))
