import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fundstelle.llm import bpe
from fundstelle.llm.bpe import codec, decode, encode
from fundstelle.llm.common import text_buffer
from fundstelle.llm.mixing import mix_sources, mixed_documents, permuted, token_spans
from fundstelle.llm.records import crc32c, masked, parse_record, read_records, write_records


def test_permutations_are_bijections():
    for n in (1, 2, 3, 10, 97, 1024, 5000):
        for key in (1, 2**63):
            out = permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(out.tolist()) == list(range(n))
    a, b = (permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k, np.uint64)) for k in (3, 4))
    assert (a != b).mean() > 0.9


def test_blocks_and_weights(spark, odd, none):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}_{j}" for j in range(40 + i % 30)), "de", f"s{i % 4 // 2}", 1) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mix_sources(docs, {"s0": 3.0, "s1": 1.0}, block_tokens=32, blocks_per_shard=50).collect()
    words = {s: [w for r in docs.where(F.col("source") == s).collect() for w in r.text.split()] for s in ("s0", "s1")}
    total = sum(-(-len(w) // 32) for w in words.values())
    assert len(out) == total and len({(r.shard, r.slot) for r in out}) == total
    assert abs(sum(r.source == "s0" for r in out) / total - 0.75) < 0.08
    for s in words:
        n = -(-len(words[s]) // 32)
        blocks = {}
        uses = {}
        for r in out:
            if r.source == s:
                assert blocks.setdefault(r.block, r.text) == r.text and len(r.text.split()) == r.n_tokens
                uses[r.block] = uses.get(r.block, 0) + 1
                assert r.n_tokens == 32 or r.block == n - 1
        spread = [uses.get(b, 0) for b in range(n)]
        assert max(spread) - min(spread) <= 1  # no block comes again before all came once
        if min(spread):
            assert sorted(w for t in blocks.values() for w in t.split()) == sorted(words[s])
    again = mix_sources(docs, {"s0": 3.0, "s1": 1.0}, block_tokens=32, blocks_per_shard=50)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out))
    got = mixed_documents(odd, block_tokens=100)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"] and got.count() > 0
    assert mix_sources(none).count() == 0 and mix_sources(docs, {"zz": 1.0}).count() == 0


def test_text_without_white_space_is_cut_to_blocks(spark):
    text = "".join(chr(0x3041 + i * 7 % 80) for i in range(80_000))
    docs = spark.createDataFrame([(1, text, "ja", "j", 80_000), (2, "x" * 50 + " é" + "ü" * 30, "de", "d", 82)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mix_sources(docs, {"j": 1.0}, block_tokens=1024).collect()
    size = -(-len(text.encode()) // 16)
    blocks = {r.block: r for r in out}
    assert len(out) == -(-size // 1024) + 1 and max(len(r.text) for r in out) <= 1024 * 6 and max(r.n_tokens for r in out) == 1024
    assert all(blocks[b].text in text for b in blocks)
    arr = pa.array(["x" * 50 + " é" + "ü" * 30, None, "", "ab cd"])
    buf, offs = text_buffer(arr)
    start, row = token_spans(buf, offs)
    ends = [min(e, offs[r + 1]) for e, r in zip([*start[1:], len(buf)], row)]
    tokens = [buf[a:b].tobytes().decode() for a, b in zip(start, ends)]
    assert "".join(tokens) == "x" * 50 + " é" + "ü" * 30 + "ab cd" and row.tolist() == [0] * 8 + [3] * 2
    assert max(len(t.encode().strip()) for t in tokens) <= 19


@pytest.mark.parametrize("alphabet", ["abcdefgh", "ab", "aaaaab", " \n\tab'st12.,!", "éüß漢字😀 a", "  \n  x", "'s't're 'll d"])
def test_joined_parts_equal_the_whole(alphabet, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_BYTES", 32)
    random.seed(alphabet)
    c = codec()
    for _ in range(300):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 300)))
        cut = random.randint(1, 80)
        whole = c.join_all([c.leaf(text[i : i + cut]) for i in range(0, len(text), cut)])
        assert whole.ids == c.encode(text) and whole.text == text
        assert c.encode_piece(text.encode()) == c._direct(text.encode())


def test_encoding_round_trips(spark, odd, none):
    unsplit = spark.createDataFrame([(50, "xyzäab" * 20_000), (51, "a" * 50_000 + " " * 40_000)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(unsplit)
    got = encode(docs, leaf_chars=10_000)
    assert got.count() == docs.count() and got.where("not round_trip").count() == 0
    back = {(r.doc_id, r.text) for r in decode(got).collect()}
    assert back == {(r.doc_id, r.text or "") for r in docs.collect()}
    want = codec().encode(unsplit.first().text)
    assert got.where("doc_id = 50").first().ids == want
    assert encode(none).count() == 0


def test_checksums_and_records(spark, tmp_path, odd, none):
    def slow(data):
        s = 0xFFFFFFFF
        for b in data:
            s ^= b
            for _ in range(8):
                s = (s >> 1) ^ (0x82F63B78 if s & 1 else 0)
        return s ^ 0xFFFFFFFF

    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 3, 4, 5, 127, 128, 129, 1000, 0, 7)] + [b"123456789"]
    buf, offs = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    got = crc32c(buf, offs)
    assert got.tolist() == [slow(p) for p in parts] and got[-1] == 0xE3069283
    assert masked(np.array([0], np.uint32))[0] == 0xA282EAD8
    uri = f"file://{tmp_path}/r"
    encoded = encode(odd)
    index = write_records(encoded, uri, max_file_bytes=1000)
    assert index.count() == odd.count()
    want = sorted((r.doc_id or -1, r.ids) for r in encoded.collect())
    assert sorted((r.doc_id or -1, r.ids) for r in read_records(index.orderBy(F.rand(3)), uri).collect()) == want
    row = index.where("n_tokens > 3").first()
    raw = (tmp_path / "r" / "data" / row.file).read_bytes()[row.offset : row.offset + row.length]
    assert parse_record(raw)[0] == row.doc_id
    for at in (3, 9, 15, len(raw) - 1):
        with pytest.raises(ValueError):
            parse_record(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
    assert write_records(encode(none), f"file://{tmp_path}/e").count() == 0


def test_unchecked_encoding_gives_the_same_ids_without_decoding(monkeypatch):
    texts = pa.array(["Der Hund läuft.", "", "漢字 ab"])
    batch = pa.record_batch([pa.array([1, 2, 3]), texts], names=["doc_id", "text"])
    with_check = next(bpe._encode_short(bpe.VOCABULARY, True)(iter([batch])))
    monkeypatch.setattr(bpe.Codec, "decode", lambda *_: 1 / 0)
    without = next(bpe._encode_short(bpe.VOCABULARY, False)(iter([batch])))
    assert without.column("ids").equals(with_check.column("ids")) and without.column("round_trip").null_count == 3
    assert with_check.column("round_trip").to_pylist() == [True] * 3
