import random

import numpy as np
import pyarrow as pa

from fundstelle.llm import linededup
from fundstelle.llm.linededup import dedup_lines, line_components
from fundstelle.llm.simhash import COSINE, THRESHOLD, bucket_links, cosines, keep_one_of_each, near_duplicates, ring_filter, segment_differences, settle, simhash_codes

WORDS = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=3 + i % 7)) for i in range(3000)]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


def _shingles(line, k=linededup.SHINGLE):
    t = line.lower()
    return {t[i : i + k] for i in range(max(1, len(t) - k + 1))}


def _groups(items, near):
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_lines_equal_brute_force(spark, odd, none):
    rng = random.Random(9)
    base = [_text(rng, rng.randint(2, 40)) for _ in range(60)]
    lines = base + [_edited(rng, b, 0.02) for b in base for _ in range(3)] + ["short", "Short", "x", "é" * 12]
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[at : at + 5]) + "\n\n") for i, at in enumerate(range(0, len(lines), 5))]
    out = dict(map(tuple, dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    distinct = list(dict.fromkeys(lines))
    sets = {x: _shingles(x) for x in distinct}
    roots = _groups(distinct, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    group, seen, want = dict(zip(distinct, roots)), set(), {}
    for i, text in docs:
        kept = []
        for line in text.split("\n"):
            if line.strip() and group[line] in seen:
                continue
            if line.strip():
                seen.add(group[line])
            kept.append(line)
        want[i] = "\n".join(kept)
    same = sum(out[i] == want[i] for i in want)
    assert same >= 0.95 * len(want)
    lost = [x for i in want for x in want[i].split("\n") if x and x not in "\n".join(out.values()).split("\n")]
    assert not lost  # nothing is dropped that brute force keeps
    got = dedup_lines(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    first = [r.text for r in got.where("doc_id = 1").collect()]
    assert len(first) == 2 and first[0] == first[1] and "bellt" in first[0]
    assert got.where("doc_id = 3").first().text is None and got.where("doc_id = 5").first().text == " \n\t\n "
    assert dedup_lines(none).count() == 0


def test_a_copied_document_is_left_without_its_lines(spark):
    docs = spark.createDataFrame([(2, "one line of some length\nanother line of text", 40), (1, "one line of some length\nanother line of text", 40)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in dedup_lines(docs).collect()}
    assert out == {1: ("one line of some length\nanother line of text", 40), 2: ("", 0)}


def test_ring_filter_never_drops_a_near_pair():
    rng = np.random.default_rng(3)
    diff = rng.integers(0, 7, (20_000, 20)).astype(np.uint8)
    near = diff.sum(1) <= THRESHOLD
    assert near.any() and ring_filter(diff, THRESHOLD)[near].all()
    assert ring_filter(rng.integers(6, 12, (1000, 20)).astype(np.uint8), THRESHOLD).mean() < 0.05


def _bag(text):
    """Weights of pairs of neighbouring words, other signs, and pairs of characters in scripts without spaces, the plain way."""
    import collections
    import math
    import re

    found = re.findall(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]+|(?:(?![\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff])[^\W_])+|[^\w\s]|_", text.lower())
    flat = [""]
    for x in found:
        flat += [x[i : i + 2] for i in range(len(x))] if re.match(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]", x) else [x]
    return {k: 1 + math.log2(c) / 2 for k, c in collections.Counter(zip(flat, flat[1:])).items()}


def _cosine(a, b):
    x, y = _bag(a), _bag(b)
    norm = (sum(w * w for w in x.values()) * sum(w * w for w in y.values())) ** 0.5
    return sum(x[k] * y.get(k, 0) for k in x) / norm if norm else 0.0


def test_cosines_equal_the_plain_form():
    texts = ["Der Hund, der bellt; der_Hund.", "漢字かな ab 漢字", "x=1+2\ny=1-2", "ÄÖ äö Ωω Жж", "", "a a a b"]
    pairs = [(a, b) for a in texts for b in texts]
    got = cosines(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]))
    assert np.allclose(got, [_cosine(a, b) for a, b in pairs])


def test_near_duplicates_equal_brute_force(spark, odd, none):
    rng = random.Random(4)
    base = [_text(rng, rng.randint(30, 120)) for _ in range(50)]
    docs = [(i, t) for i, t in enumerate(base + [_edited(rng, b, 0.04) for b in base for _ in range(2)] + base[:10] + [_text(rng, 50) for _ in range(60)])]
    codes, _ = simhash_codes(pa.array([t for _, t in docs]))
    near = lambda a, b: int(segment_differences(codes[a : a + 1].copy(), codes[b : b + 1].copy()).sum()) <= THRESHOLD and _cosine(docs[a][1], docs[b][1]) >= COSINE
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.duplicate_of for r in near_duplicates(df).collect()}
    assert all(r not in got and _cosine(docs[i][1], docs[r][1]) >= COSINE for i, r in got.items())
    kept = [i for i in range(len(docs)) if i not in got]
    assert not [(i, j) for i in kept for j in kept if j < i and near(i, j)]  # the kept ones are all different
    assert len(got) >= 0.95 * 110 and not set(got) & set(range(160, 220)) and all(i in got for i in range(150, 160))  # exact copies
    assert keep_one_of_each(df).count() == len(docs) - len(got)
    rest = keep_one_of_each(odd)
    assert rest.columns == odd.columns and rest.count() == odd.count()
    assert near_duplicates(none).count() == 0
    same = spark.createDataFrame([(5, "alpha beta gamma delta"), (3, "alpha beta gamma delta"), (4, "Alpha beta GAMMA delta")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(same).collect())) in ([(4, 3), (5, 3)], [(3, 4), (5, 4)])


def test_texts_that_share_long_words_or_letters_alone_stay(spark):
    rng = random.Random(6)
    short = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(600)]
    numbers = [" ".join(f"{rng.randint(0, 999)}" for _ in range(200)) for _ in range(2)]
    code = ["a = b + c * d ; " * 20, "a ( b ) [ c ] { d } " * 20]
    texts = ["Regierung " + " ".join(short[:300]), "Regierung " + " ".join(short[300:]), "Tabelle Nummern " + numbers[0], "Tabelle Nummern " + numbers[1], *code]
    texts += [f"{'!! '.join(rng.sample(WORDS, 60)).upper()}!!" for _ in range(20)]
    assert near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 0


def test_a_chain_goes_only_as_far_as_texts_are_near(spark):
    rng = random.Random(16)
    chain = [_text(rng, 200)]
    for _ in range(12):
        chain.append(_edited(rng, chain[-1], 0.06))
    got = {r.doc_id: r.duplicate_of for r in near_duplicates(spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")).collect()}
    assert got and all(r not in got and _cosine(chain[i], chain[r]) >= COSINE for i, r in got.items())
    assert 3 <= len(set(range(13)) - set(got)) <= 7


def test_rounds_and_one_task_settle_alike(spark):
    rng = np.random.default_rng(21)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 120, (260, 2)) if a != b} | {(200 + i, 201 + i) for i in range(40)} | {(300, 301 + i) for i in range(50)}
    links = spark.createDataFrame(sorted(pairs), "u long, v long")
    here = dict(map(tuple, settle(links).collect()))
    assert here == dict(map(tuple, settle(links, 0).collect()))
    assert all(tuple(sorted(x)) in pairs and x[1] not in here for x in here.items())
    assert not [p for p in pairs if p[0] not in here and p[1] not in here]


def test_bucket_links_connect_what_all_pairs_would():
    rng = np.random.default_rng(11)
    centre = rng.integers(0, 2, (30, 320)).astype(np.uint8)
    rows, keys = [], []
    for k in range(12):
        for c in rng.integers(0, 30, 4):
            for _ in range(rng.integers(1, 30)):
                x = centre[c].copy()
                x[rng.permutation(320)[: rng.integers(0, 60)]] ^= 1
                rows.append(x)
                keys.append(k)
    order = np.argsort(keys, kind="stable")
    key, code = np.array(keys)[order], np.packbits(np.array(rows)[order], axis=1)
    node = np.arange(len(key))
    u, v = bucket_links(key, node, code)
    assert len(u) < 2 * len(key)
    linked = set(zip(u.tolist(), v.tolist()))
    dist = np.bitwise_count(code.view(np.uint64)[:, None] ^ code.view(np.uint64)[None]).sum(2)
    all_pairs = lambda i, j: key[i] == key[j] and dist[i, j] <= THRESHOLD
    assert all(all_pairs(i, j) for i, j in linked)
    assert _groups(node.tolist(), all_pairs) == _groups(node.tolist(), lambda i, j: (i, j) in linked or (j, i) in linked)
