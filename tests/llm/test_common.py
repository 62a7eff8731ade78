import numpy as np
import pyarrow as pa

from fundstelle.llm.common import Hasher, lower_bytes, pieces, text_buffer, word_spans
from fundstelle.llm.components import components


def test_words_and_hashes_do_not_depend_on_the_batch():
    texts = ["ab cd", None, "", "  x\tyz ", "ÄÖ é", "cd"]
    buf, offs = text_buffer(pa.array(texts))
    s, e, row = word_spans(buf, offs)
    raw = buf.tobytes()
    assert [(int(r), raw[a:b].decode()) for a, b, r in zip(s, e, row)] == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]
    h = Hasher(buf)(s, e)
    assert h[1] == h[-1] and len(set(h.tolist())) == len({w for t in texts for w in (t or "").split()})
    assert lower_bytes(np.frombuffer("AÄÖÉ×z".encode(), np.uint8)).tobytes().decode() == "aäöé×z"


def test_pieces_cut_by_bytes_and_keep_rows():
    batch = pa.record_batch([pa.array(["aaaa", "", None, "b" * 50, "c"])], names=["text"])
    parts = list(pieces(iter([batch, batch.slice(0, 0)]), "text", 5))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) > 2


def test_components_equal_a_plain_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7), (None, 3)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    for one_task in (0, 1 << 19):
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), one_task).collect()}
        assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
