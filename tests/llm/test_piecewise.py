import random

import numpy as np
import pyarrow as pa
import pytest

from fundstelle.llm import bpe
from fundstelle.llm.bpe import Codec, codec
from fundstelle.llm.piecewise import PieceIds, byte_classes


def same_as_library(c, texts):
    for at in range(0, len(texts), 2000):
        part = texts[at : at + 2000]
        want = [c.encode(t) for t in part]
        ids, counts = c.encode_rows(pa.array(part, pa.string()))
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


def test_each_character_of_the_bmp_splits_as_in_the_library():
    signs = [chr(i) for i in range(1 << 16) if not 0xD800 <= i < 0xE000]
    same_as_library(codec(), [f"a{x}b 1{x}2 {x}{x} .{x}'{x}s{x}'s {x}  {x}a  " for x in signs])


@pytest.mark.parametrize("alphabet", ["ab c", " \n\ta'st12.,!", "'s't're'll'd'm've S", "éüß漢字😀 a 　", "  \n  x.", "\0 a\0"])
def test_rows_of_any_signs_get_the_ids_of_the_library(alphabet):
    random.seed(alphabet)
    c = Codec()
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(3000)]
    for bits in (3, 12):  # most pieces are driven out of the smaller table again and again
        c.known = PieceIds(bits)
        same_as_library(c, texts + ["", "x" * 15, "x" * 16, "", *texts[:200], "y" * 5000])
        same_as_library(c, [])
    got = [c.leaf(t) for t in texts[:500]]
    c.known = None
    assert got == [c.leaf(t) for t in texts[:500]]


def test_pieces_that_came_before_are_not_encoded_again(monkeypatch):
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["Straßenbahnen erzuckeln quafflig 4711, wohl's.", "漢字 quafflig"])], names=["doc_id", "text"])
    once = next(bpe._encode_short(bpe.VOCABULARY, False)(iter([batch])))
    for name in ("encode", "encode_piece", "_direct"):
        monkeypatch.setattr(bpe.Codec, name, lambda *_: 1 / 0)
    again = next(bpe._encode_short(bpe.VOCABULARY, False)(iter([batch.slice(1), batch.slice(0, 1)])))
    assert again.column("ids").to_pylist() == once.column("ids").to_pylist()[1:]


def test_signs_newer_than_unicode_3_2_leave_the_row_whole():
    assert byte_classes(np.frombuffer("a1 . é\U0001f600".encode(), np.uint8)).tolist() == [0, 1, 2, 3, 2, 2, 0, 0, 4, 4, 4, 4]


def test_damaged_text_is_an_error():
    c = codec()
    damaged = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, 2], np.int32)), pa.py_buffer(b"a\xc3")])
    with pytest.raises(ValueError):
        c.encode_rows(damaged)
