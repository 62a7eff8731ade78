import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fundstelle.llm import ann
from fundstelle.llm.ann import nearest_neighbours, substring_candidates
from fundstelle.llm.common import lower_bytes
from fundstelle.llm.langid import _LEAD, SCRIPT_LANGUAGE, SCRIPTS, _identify, identify_languages, keep_identified, train, viterbi
from fundstelle.llm.quality import co_train, logits, metadata_features, score_quality, sigmoid, text_features, trigram_counts

SF = "/root/testdata/sf0.01"


def test_viterbi_equals_the_plain_form():
    rng = np.random.default_rng(8)
    count = rng.integers(0, 30, 40)
    first = np.cumsum(count) - count
    score = rng.normal(0, 3, (count.sum(), 4)).astype(np.float32)
    got = viterbi(score, first, count, 4.0)
    for f, n in zip(first, count):
        if not n:
            continue
        s = score[f : f + n].astype(np.float64)
        v, back = s[0], []
        for t in range(1, n):
            trans = v[:, None] - 4.0 * (1 - np.eye(4))
            back.append(trans.argmax(0))
            v = trans.max(0) + s[t]
        path = [int(v.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path = path[::-1]
        cost = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert abs(cost(path) - cost(got[f : f + n].tolist())) < 1e-3
    assert len(viterbi(np.zeros((0, 3), np.float32), np.zeros(2, np.int64), np.zeros(2, np.int64), 1.0)) == 0


def test_held_out_languages_and_mixed_text(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs.where("doc_id < 500"))
    rest = docs.where("doc_id >= 500")
    got = identify_languages(rest, model).join(rest.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.label == r.lang for r in got]) > 0.97 and all(r.accepted for r in got)
    parts = {r.lang: r.text.split("\n")[0] for r in docs.where("doc_id < 300 and length(text) > 600").collect() if len(r.text.split("\n")[0]) > 80}
    de, en = parts["de"], parts["en"]
    text = f"{de} {en} Привет, как дела сегодня?"
    row = identify_languages(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s.lang for s in row.spans] == ["de", "en", "ru"] and row.mixed
    assert abs(row.spans[1].start - len(de) - 1) < 25
    out = {r.doc_id: r for r in identify_languages(odd, model).collect()}
    assert not any(out[i].accepted for i in (3, 4, 5, 7)) and out[3].label is None and out[2].accepted
    kept = keep_identified(odd, model)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 6, 8]
    assert identify_languages(none).count() == 0


def plain_identify(text, model, penalty):
    """Label, share, acceptance and spans of one text, word by word."""
    data = (text or "").encode()
    low = lower_bytes(np.frombuffer(data, np.uint8)).tobytes()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x00-\x20]+", low)]
    script = [max(int(_LEAD[low[i], low[i + 1] if i + 1 < len(low) else 32]) if i + 1 < b else int(_LEAD[low[i], 32]) for i in range(a, b)) for a, b in words]
    extra = [i for i in range(2, len(SCRIPTS)) if i in script and not model.allowed[i].any()]
    langs = [*model.langs, *(SCRIPT_LANGUAGE[SCRIPTS[i]] for i in extra)]
    n, scores, own, grams = len(model.langs), [], [], []
    for (a, b), sid in zip(words, script):
        padded = b" " + low[a:b] + b" "
        h = [((x << 16 | y << 8 | z) * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for x, y, z in zip(padded, padded[1:], padded[2:])]
        own.append(model.table[h].sum(0))
        grams.append(b - a)
        if sid == 0:
            scores.append([0.0] * len(langs))
        else:
            allowed = [bool(model.allowed[sid][j]) for j in range(n)] + [x == sid for x in extra]
            base = list(own[-1]) + [0.0] * len(extra)
            scores.append([s if ok or not any(allowed) else -1e4 for s, ok in zip(base, allowed)])
    if not words:
        return None, 0.0, False, []
    v, back = list(scores[0]), []
    for s in scores[1:]:
        best = max(range(len(v)), key=lambda i: v[i])
        back.append([best if v[best] - penalty > v[i] else i for i in range(len(v))])
        v = [max(v[i], v[best] - penalty) + s[i] for i in range(len(v))]
    path = [max(range(len(v)), key=lambda i: v[i])]
    for b in reversed(back):
        path.append(b[path[-1]])
    path.reverse()
    by = [sum(e - a for (a, e), p, sid in zip(words, path, script) if p == j and sid) for j in range(len(langs))]
    letters, best = sum(by), max(range(len(by)), key=lambda j: by[j])
    fits = [(own[i][p], grams[i]) for i, p in enumerate(path) if script[i] and p < n]
    mean = sum(f for f, _ in fits) / max(1, sum(g for _, g in fits))
    spans = []
    for (a, e), p in zip(words, path):
        a, e = len(data[:a].decode()), len(data[:e].decode())
        if spans and spans[-1][2] == langs[p]:
            spans[-1] = (spans[-1][0], e, langs[p])
        else:
            spans.append((a, e, langs[p]))
    return langs[best] if letters else None, by[best] / letters if letters else 0.0, bool(letters) and mean > -16 * np.log(2), spans


def test_each_document_is_labelled_as_if_alone(spark, odd):
    """Against the plain form: the whole table, row by row, and in another order and company."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400").select("doc_id", "text")
    model = train(spark.read.parquet(f"{SF}/documents.parquet"))
    more = ["2004 2005 2004 2005", "漢字", "2004 漢字 abc der die und 12", "Привет мир und the 5 dog", "12 der Hund 13 läuft", "ab\u00a0c ελληνικά x", None, "", "7"]
    texts = [(r.doc_id, r.text) for r in docs.union(odd.select("doc_id", "text").where("doc_id <> 1")).collect() if r.text is None or len(r.text) < 20000] + [(1000 + i, t) for i, t in enumerate(more)]
    whole = _identify(pa.array([t for _, t in texts], pa.string()), model, 12.0)
    order = np.random.default_rng(3).permutation(len(texts))
    mixed = _identify(pa.array([texts[i][1] for i in order], pa.string()), model, 12.0)
    assert all(w.take(pa.array(order)).equals(m) for w, m in zip(whole, mixed))
    for i, (_, t) in enumerate(texts):
        alone = [c[0].as_py() for c in _identify(pa.array([t], pa.string()), model, 12.0)]
        assert alone == [c[i].as_py() for c in whole]
        label, share, accepted, spans = plain_identify(t, model, 12.0)
        assert (alone[0], alone[2], [(s["start"], s["end"], s["lang"]) for s in alone[4]]) == (label, accepted, spans), t
        assert abs(alone[1] - share) < 1e-9


def test_quality_on_held_out_labels(spark, odd, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = labels.where("doc_id < 5000")
    got = score_quality(docs, known).join(labels.where("doc_id >= 5000"), "doc_id").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in got]) > 0.97
    assert np.mean([r.keep for r in got if r.quality == 1]) > 0.98
    out = score_quality(odd, none.selectExpr("doc_id", "cast(null as int) as quality"))
    assert out.count() == odd.count() and out.where("not keep or score is not null").count() == 0
    few = spark.createDataFrame([(1, 1), (2, 0), (6, 1), (99, 0), (None, 1), (2, 7)], "doc_id long, quality int")
    assert score_quality(odd, few).count() == odd.count()
    assert score_quality(none, few).count() == 0


def array_pool(xt, xm, ids, tie=None):
    """The pool of ``co_train`` over arrays, by sorting."""

    def pool(fitted, quotas, confidence, given):
        out = {}
        for v in (0, 1):
            w, platt = fitted[v]
            z = logits((xt, xm)[v], w).astype(np.float64) * platt[0] + platt[1]
            for label in (1, 0):
                q = z if label else -z
                order = sorted((i for i in range(len(ids)) if q[i] >= np.log(confidence / (1 - confidence)) and ids[i] not in given[v]), key=lambda i: (-round(q[i], 3), tie[ids[i]] if tie else i))
                out[v, label] = [(ids[i], (xt[i], xm[i])) for i in order[: quotas[label]]]
        return out

    return pool


def test_co_training_adds_confident_labels():
    rng = np.random.default_rng(6)
    y = np.array([0, 1] * 300)
    counts = rng.poisson(1 + 3 * y[:, None] * (np.arange(1024) < 512) + 3 * (1 - y[:, None]) * (np.arange(1024) >= 512)).astype(np.float32)
    meta = np.zeros((600, 134), np.float32)
    meta[np.arange(600), y] = 1
    held = np.arange(200) < 100
    mean = (counts.sum(0) + 1) / (counts.sum() + 1024)
    xt = text_features(counts, mean)
    model = co_train(xt[:200], meta[:200], y[:200], held, mean, array_pool(xt[200:], meta[200:], list(range(200, 600))))
    assert model.added and model.added[0] > 0
    f = text_features(counts, model.mean)
    assert np.mean((f @ model.text[:-1] + model.text[-1] > 0) == (y == 1)) > 0.95
    assert trigram_counts(pa.array([None, "", "ab", "abcd"])).sum(1).tolist() == [0, 0, 0, 2]
    assert metadata_features([None, "a"], ["de", None], [None, 5], np.array([0, 1])).shape == (2, 134)
    long = "s" * 70
    rows = metadata_features([None, "\0", long + "a", long + "b"], ["de"] * 4, [5] * 4, np.ones(4))
    assert len(np.unique(rows, axis=0)) == 4


def test_scores_equal_a_plain_version_over_the_whole_table(spark):
    """All of op10 again with lists and one machine's arrays: shares, fits, rounds over all unlabelled documents, scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}
    rows = {r.doc_id: r for r in docs.orderBy("doc_id").collect()}
    known = {}
    for r in labels.collect():
        known[r.doc_id] = min(r.quality, known.get(r.doc_id, 1))
    known = {i: q for i, q in known.items() if i in rows}
    ids = sorted(rows)
    counts = np.array([np.bincount([((max(a, 32) << 16 | max(b, 32) << 8 | max(c, 32)) * 0x9E3779B1 & 0xFFFFFFFF) >> 22 for a, b, c in zip(t, t[1:], t[2:])], minlength=1024) for t in (rows[i].text.encode() for i in ids)], np.float64)
    total = counts.sum(0) + 1
    mean = total / total.sum()
    xt = text_features(counts.astype(np.float32), mean)
    lines = np.array([rows[i].text.count("\n") + bool(rows[i].text) for i in ids])
    xm = metadata_features([rows[i].source for i in ids], [rows[i].lang for i in ids], [rows[i].n_chars for i in ids], lines)
    at = [j for j, i in enumerate(ids) if i in known]
    rest = [j for j, i in enumerate(ids) if i not in known]
    held = dict(spark.createDataFrame([(i,) for i in known], "i long").select("i", F.pmod(F.xxhash64(F.lit(8), "i"), F.lit(1000)) < 250).collect())
    tie = dict(spark.createDataFrame([(i,) for i in ids], "i long").select("i", F.xxhash64("i")).collect())
    y = np.array([known[ids[j]] for j in at])
    model = co_train(xt[at], xm[at], y, np.array([held[ids[j]] for j in at]), mean, array_pool(xt[rest], xm[rest], [ids[j] for j in rest], tie))
    assert sum(model.added) > 0
    z = [logits(x, w) * p[0] + p[1] for x, w, p in zip((xt, xm), (model.text, model.meta), model.platt)]
    want = sigmoid(z[0] + z[1] - model.prior)
    assert max(abs(got[i] - w) for i, w in zip(ids, want)) < 0.02
    assert np.mean([(got[i] >= 0.5) == (w >= 0.5) for i, w in zip(ids, want)]) > 0.995


def test_pigeonhole_probing_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, 500, dtype=np.int64).view(np.uint64)
    queries = codes[:50] ^ np.uint64(0x0101010100010001)
    for radius in (0, 7, 12, 26):
        ok = np.unpackbits(substring_candidates(queries, codes, radius), axis=1, count=500).astype(bool)
        near = np.bitwise_count(queries[:, None] ^ codes[None]) <= radius
        assert ok[near].all()


def test_neighbours_against_brute_force(spark, monkeypatch):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").limit(400)
    rows = emb.collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = x @ x.T
    np.fill_diagonal(sim, -9)
    ids = [r.vec_id for r in rows]
    truth = {ids[i]: {ids[j] for j in np.argsort(-sim[i])[:10]} for i in range(len(ids))}
    got = nearest_neighbours(spark.createDataFrame(rows), block=150).collect()
    assert sum(r.neighbour in truth[r.vec_id] for r in got) >= 0.9 * 10 * len(ids)
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [0.0, 0.0]), (7, [1.0]), (8, [1.0, None])], "vec_id long, embedding array<double>")
    out = {(r.vec_id, r.rank): r.neighbour for r in nearest_neighbours(odd, k=1, radius=64).collect()}
    assert out[(1, 1)] == 2 and out[(2, 1)] == 1 and set(k[0] for k in out) == {1, 2, 6}
    assert nearest_neighbours(odd.limit(0)).count() == 0
    assert ann.BITS == 64


def test_queries_of_every_nth_id_see_all_rows_without_pairs_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    x[1500:] = x[:1500] + rng.normal(size=(1500, 24)) * 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(ann, "SHARED_QUERIES", 25)  # several passes
    rows = nearest_neighbours(df, block=200, every=50).collect()
    asked = range(0, 3000, 50)
    assert {r.vec_id for r in rows} == set(asked)
    sim = x[::50] @ x.T
    sim[np.arange(60), np.arange(0, 3000, 50)] = -9
    truth = {i: set(np.argsort(-s)[:10].tolist()) for i, s in zip(asked, sim)}
    assert sum(r.neighbour in truth[r.vec_id] for r in rows) >= 0.9 * 600
    got = {(r.vec_id, r.rank): r.neighbour for r in nearest_neighbours(df, k=1, radius=12, block=200, every=50).collect()}
    assert sum(got.get((i, 1)) == (i + 1500) % 3000 for i in asked) >= 55  # the byte tables' way
