import random

import numpy as np
import pyarrow as pa

from fundstelle.llm import linededup
from fundstelle.llm.linededup import _shingle_sets, dedup_lines, joined_within, signatures, sketches

WORDS = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=3 + i % 7)) for i in range(3000)]


def test_short_lines_with_one_character_or_word_replaced_are_joined(spark):
    rng = random.Random(12)
    pairs = {"character": [], "word": []}
    while len(pairs["character"]) < 200:
        line = " ".join(rng.choice(WORDS) for _ in range(10))
        if 52 <= len(line) <= 88:
            at = rng.randrange(len(line))
            pairs["character"].append((line, line[:at] + "7" + line[at + 1 :]))
    while len(pairs["word"]) < 200:
        words = [rng.choice(WORDS) for _ in range(14)]
        at = rng.randrange(14)
        if 80 <= len(" ".join(words)) <= 88 and len(words[at]) == 3:
            pairs["word"].append((" ".join(words), " ".join([*words[:at], "qzx", *words[at + 1 :]])))
    for kind, made in pairs.items():
        docs = spark.createDataFrame([(2 * i + j, line) for i, pair in enumerate(made) for j, line in enumerate(pair)], "doc_id long, text string")
        out = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
        joined = sum(out[2 * i + 1] == "" for i in range(len(made))) / len(made)
        print(f"one {kind} replaced: {joined:.3f} joined")
        assert joined >= 0.9
        assert all(out[2 * i] == made[i][0] for i in range(len(made)))


def test_lines_of_any_white_space_stay(spark):
    rows = [(1, "erste Zeile\r\n\r\nzweite Zeile\r\n \t\r\n　 \n"), (2, "vierte Zeile\r\n\r\nfünfte Zeile\r\n　 \n \t\r\nzweite Zeile\r\n")]
    out = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "vierte Zeile\r\n\r\nfünfte Zeile\r\n　 \n \t\r\n"}


def test_lower_case_of_other_scripts(spark):
    rows = [(1, "Он вернулся домой поздно вечером, когда все спали"), (2, "ОН ВЕРНУЛСЯ ДОМОЙ ПОЗДНО ВЕЧЕРОМ, КОГДА ВСЕ СПАЛИ")]
    assert {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: rows[0][1], 2: ""}


def test_many_variants_of_one_line_are_one_component(spark):
    rng = random.Random(3)
    lead = "Sehr geehrte Damen und Herren, wir bestätigen Ihnen hiermit den Eingang der Bestellung mit der Nummer "
    lines = sorted({f"{lead}{rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}" for _ in range(6000)})
    rng.shuffle(lines)
    docs = spark.createDataFrame([(i, "\n".join(lines[i * 100 : i * 100 + 100])) for i in range(len(lines) // 100)], "doc_id long, text string")
    left = [x for r in dedup_lines(docs).collect() for x in r.text.split("\n") if x]
    assert left == [lines[0]]


def _groups(items, near):
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in items:
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in items]


def test_sketches_find_all_that_all_pairs_do():
    rng = random.Random(8)
    lines = []
    for _ in range(6):
        base = rng.choices(WORDS, k=24)
        lines += [" ".join(x if rng.random() > 0.04 else rng.choice(WORDS) for x in base) for _ in range(12)]
    arr = pa.array(lines)
    sets = _shingle_sets(arr)
    for t in (0.5, 0.8, 0.9):
        links = joined_within(arr, sketches(signatures(arr)), np.arange(len(lines)), np.zeros(len(lines), int), t)
        full = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])]
        assert {frozenset(x) for x in links} <= {frozenset(x) for x in full} and len(links) < len(sets)
        group = lambda edges: _groups(list(range(len(sets))), lambda a, b: (a, b) in edges or (b, a) in edges)
        assert group(set(links)) == group(set(full))
        cell = np.arange(len(lines)) // 7
        links = joined_within(arr, sketches(signatures(arr)), np.arange(len(lines)), cell, t)
        assert group(set(links)) == group({(i, j) for i, j in full if cell[i] == cell[j]})


def test_maps_rule_out_most_unlike_pairs_and_no_like_one(monkeypatch):
    rng = random.Random(41)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(300)]
    common = " ".join(rng.choices(words, k=36))  # lines of an index of about 0.65: their sketches agree often
    lines = [f"{common} {' '.join(rng.choices(words, k=9))}" for _ in range(150)] + ["ab", "", "aaaaaaaaaaaaaaaa"]
    lines += [x[:50] + "#" + x[51:] for x in lines[:20]]
    arr = pa.array(lines)
    sets = _shingle_sets(arr)
    x, y = np.triu_indices(len(lines), 1)
    like = np.array([bool(sets[i] | sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in zip(x, y)])
    own = linededup._Sets(arr)
    may = linededup.may_be_alike(own, x, own, y, 0.8)
    assert like.sum() >= 20 and may[like].all() and may[~like].mean() < 0.1
    compared = []
    alike = linededup._alike
    monkeypatch.setattr(linededup, "_alike", lambda a, b, t: compared.append(1) or alike(a, b, t))
    n = len(lines)
    links = linededup.joined_within(arr, sketches(signatures(arr)), np.arange(n), np.zeros(n, np.int64), 0.8)
    assert len(links) >= 19 and len(compared) < 600  # thousands before
