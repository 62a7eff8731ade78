import random

import numpy as np
from pyspark.sql import functions as F

from fundstelle.llm.fingerprints import differences, version_differences
from fundstelle.llm.sharding import karmarkar_karp, shard_groups


def _plain_kk(sizes, k):
    """Differencing on full tuples, item by item."""
    parts = [(([s] + [0] * (k - 1)), [[i]] + [[] for _ in range(k - 1)], n) for n, (i, s) in enumerate(enumerate(sizes))]
    n = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][0] - p[0][-1]), p[2]))
        (a, x, _), (b, y, _) = parts[:2]
        merged = sorted(zip([a[i] + b[k - 1 - i] for i in range(k)], [x[i] + y[k - 1 - i] for i in range(k)]), key=lambda t: -t[0])
        parts = parts[2:] + [([m[0] for m in merged], [m[1] for m in merged], n)]
        n += 1
    return sorted(parts[0][0])


def test_differencing_matches_the_plain_form_and_beats_greedy():
    random.seed(2)
    for _ in range(60):
        k, sizes = random.randint(2, 6), [random.randint(1, 10_000) for _ in range(random.randint(1, 60))]
        part = karmarkar_karp(sizes, k)
        sums = [sum(s for s, p in zip(sizes, part) if p == j) for j in range(k)]
        assert sorted(sums) == _plain_kk(sizes, k)
    big = [random.randint(1, 10**6) for _ in range(400)]
    part = karmarkar_karp(big, 8)
    sums = np.bincount(part, weights=big)
    greedy = np.zeros(8)
    for s in sorted(big, reverse=True):
        greedy[greedy.argmin()] += s
    assert np.ptp(sums) <= np.ptp(greedy)
    assert karmarkar_karp([], 3) == [] and karmarkar_karp([5, 5], 1) == [0, 0]


def test_shards_keep_groups_and_balance(spark, odd, none):
    rows = [(i, f"text {i % 700} " * (1 + (i * 7919) % 97), f"s{i % 3}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = shard_groups(docs, shard_bytes=20_000, min_shards=4, shards_per_bucket=4).collect()
    assert len(out) == 2000
    by_text, sums = {}, {}
    text = {r[0]: r[1] for r in rows}
    for r in out:
        by_text.setdefault(text[r.doc_id], set()).add(r.shard)
        sums[r.shard] = sums.get(r.shard, 0) + r.n_bytes
    assert all(len(v) == 1 for v in by_text.values())
    assert max(sums.values()) < 1.1 * sum(sums.values()) / len(sums)
    assert len({r.shard for r in shard_groups(docs, F.col("source")).collect()}) == 3
    got = shard_groups(odd)
    assert got.count() == odd.count() and got.where("shard is null or n_bytes is null").count() == 0
    assert shard_groups(none).count() == 0


def test_sketches_recover_every_difference():
    rng = np.random.default_rng(4)
    old, new, want = ([], []), ([], []), set()
    for own in range(40):
        a = set(rng.integers(0, 1 << 60, rng.integers(0, 400)).tolist())
        b = set(rng.permutation(list(a))[: len(a) // 2].tolist()) | set(rng.integers(0, 1 << 60, rng.integers(0, 300)).tolist())
        for side, keys in ((old, a), (new, b)):
            side[0].extend([own] * len(keys))
            side[1].extend(keys)
        want |= {(own, k, -1) for k in a - b} | {(own, k, 1) for k in b - a}
    pack = lambda s: (np.array(s[0], np.int64), np.array(s[1], np.uint64))
    own, key, sign, cells = differences(pack(old), pack(new), 40, cells=8)
    assert set(zip(own.tolist(), key.tolist(), sign.tolist())) == want and cells.max() > 8


def test_versions_follow_each_other(spark, odd, none):
    docs = spark.createDataFrame([(1, "T\na\nb"), (2, "T\na\nc\nc"), (3, "T\na\nc"), (9, "other"), (4, None), (5, "\n \n")], "doc_id long, text string")
    out = {r.doc_id: r for r in version_differences(docs).collect()}
    assert set(out) == {1, 2, 3, 9}
    assert (out[1].prev_id, out[1].n_added, out[2].prev_id, out[2].n_removed, out[2].n_added, out[3].n_added) == (None, 3, 1, 1, 1, 0)
    got = {(r.doc_id, r.prev_id): (r.n_removed, r.n_added) for r in version_differences(odd).collect()}
    assert got[(1, 1)] == (0, 0) and got[(1, None)][1] == 2 and (3, None) not in got
    assert version_differences(none).count() == 0
