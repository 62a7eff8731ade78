import random

import numpy as np
import pyarrow as pa
import pytest

from fundstelle.llm import linededup
from fundstelle.llm.linededup import BANDS, _emit_bands, _packed, _stars, band_keys, digests, line_spans, signatures


def _unpacked(batches):
    return np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 4) for b in batches for x in b.column("rows").to_pylist()])


def test_band_rows_travel_packed():
    rng = random.Random(5)
    lines = [" ".join(rng.choices(["eins", "zwei", "drei", "vier", "fünf", "sechs"], k=9)) + f" {i}" for i in range(3000)]
    texts = ["\n".join(lines[i : i + 20]) for i in range(0, 3000, 20)]
    out = list(_emit_bands(12)(iter([pa.record_batch([pa.array(texts)], names=["text"])])))
    assert sum(b.num_rows for b in out) <= 12 * (1 + 3000 * BANDS // (12 * linededup.PACKED) + 1)  # 24,000 before
    raw = "\n".join(lines).encode()
    start, end, _, _ = line_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    h, keys = digests(raw, start, end)[:, 0], band_keys(signatures(pa.array(lines))).view(np.int64)
    rows = _unpacked(out)
    assert len(rows) == 3000 * BANDS and {*zip(rows[:, 0].tolist(), rows[:, 1].tolist())} == {(k, x) for x, ks in zip(h.tolist(), keys.tolist()) for k in ks}


@pytest.mark.parametrize("held", [1 << 19, 64])
def test_each_band_has_one_first_line_also_in_parts(monkeypatch, held):
    monkeypatch.setattr(linededup, "HELD", held)
    monkeypatch.setattr(linededup, "PACKED", 16)
    rng = np.random.default_rng(held)
    band = np.concatenate([rng.integers(0, 5, 1000), rng.integers(5, 2000, 1000)])  # some large, most of one line or two
    rows = np.stack([band, rng.integers(0, 400, 2000), *rng.integers(-9, 9, (2, 2000))], axis=1)
    parts = [_packed(part, 3) for part in np.array_split(rng.permutation(rows), 7)]
    t = pa.Table.from_batches(parts).sort_by("bucket")
    out = pa.Table.from_batches([*_stars(0.8)(iter(t.to_batches()))])
    found, hubs, more = {}, {}, {}
    for x, hub, h, m in zip(*(out.column(c).to_pylist() for c in ("band", "hub", "h", "more"))):
        assert hub != h
        hubs.setdefault(x, set()).add(hub)
        found.setdefault(x, set()).add(h)
        more[x] = more.get(x, True) and m
    want = {}
    for x, h in rows[:, :2].tolist():
        want.setdefault(x, set()).add(h)
    want = {x: hs for x, hs in want.items() if len(hs) > 1}
    assert all(len(x) == 1 for x in hubs.values()) and {x: hubs[x] | hs for x, hs in found.items()} == want
    assert all(more[x] for x, hs in want.items() if len(hs) > 2)
    if held > 64:
        assert all(hubs[x] == {min(hs)} and more[x] == (len(hs) > 2) for x, hs in want.items())


def test_strings_keep_bytes_of_any_kind():
    raw = "aß\n漢字\nb".encode() + b"\n\xff\xfe"
    start, end, _, _ = line_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert linededup._strings(raw, start, end).cast(pa.binary()).to_pylist() == raw.split(b"\n")
