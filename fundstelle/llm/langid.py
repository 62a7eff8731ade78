"""Language spans of mixed text: script ranges, trigram word scores, and Viterbi with a switching penalty."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, bounded_sample, documents, lower_bytes, pieces, text_buffer, tidy, word_spans

#: The fit reads so many labelled documents of each language at most.
TRAIN_DOCS_PER_LANG = 400
SWITCH_PENALTY = 12.0
TABLE_BITS = 16
FORBIDDEN = -1e4

SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "devanagari", "thai", "kana", "hangul", "han")
#: The language that a script stands for where no trained language uses it.
SCRIPT_LANGUAGE = {"greek": "el", "cyrillic": "ru", "hebrew": "he", "arabic": "ar", "devanagari": "hi", "thai": "th", "kana": "ja", "hangul": "ko", "han": "zh"}
SCRIPT_SHARE = 0.02


def _lead_scripts() -> np.ndarray:
    """Script by a character's first two UTF-8 bytes."""
    t = np.zeros((256, 256), np.uint8)
    n = {s: i for i, s in enumerate(SCRIPTS)}
    t[ord("A") : ord("Z") + 1] = t[ord("a") : ord("z") + 1] = n["latin"]
    t[0xC3:0xCA] = n["latin"]
    t[0xC2, 0xAA] = t[0xC2, 0xBA] = n["latin"]
    t[0xC3, 0x97] = t[0xC3, 0xB7] = 0
    t[0xE1, 0xB8:0xBC] = n["latin"]
    t[0xCD:0xD0] = t[0xE1, 0xBC:0xC0] = n["greek"]
    t[0xD0:0xD4] = n["cyrillic"]
    t[0xD6, 0x90:] = t[0xD7] = n["hebrew"]
    t[0xD8:0xDC] = n["arabic"]
    t[0xE0, 0xA4:0xA6] = n["devanagari"]
    t[0xE0, 0xB8:0xBA] = n["thai"]
    t[0xE3, 0x81:0x84] = n["kana"]
    t[0xE1, 0x84:0x88] = t[0xEA, 0xB0:] = t[0xEB:0xED] = t[0xED, :0xA0] = n["hangul"]
    t[0xE3, 0x90:] = t[0xE4:0xEA] = t[0xF0, 0xA0:0xB0] = n["han"]
    return t


_LEAD = _lead_scripts()


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities of hashed byte trigrams, and which language may use which script."""

    langs: tuple[str, ...]
    table: np.ndarray  # (2**TABLE_BITS + 1, languages); the last row is 0
    allowed: np.ndarray  # (scripts, languages)


def _padded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts with white space as one value and a space around each."""
    n = len(offs) - 1
    out = np.full(len(buf) + n + 2, 32, np.uint8)
    lens = np.diff(offs)
    out[np.arange(len(buf)) + np.repeat(np.arange(1, n + 1), lens)] = np.maximum(lower_bytes(buf), 32)
    return out, offs + np.arange(1, n + 2)


def _trigrams(pad: np.ndarray) -> np.ndarray:
    """Hash of the three bytes from each place on; the empty row where the middle one is no part of a word."""
    x = pad.astype(np.uint32)
    h = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)
    h[pad[1:-1] == 32] = 1 << TABLE_BITS
    return h


def _scripts(pad: np.ndarray) -> np.ndarray:
    s = np.zeros(len(pad), np.uint8)
    s[:-1] = _LEAD[pad[:-1], pad[1:]]
    return s


def word_scores(buf: np.ndarray, offs: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, ...]:
    """Words' byte ranges, rows, log-probabilities by language, trigram counts and scripts."""
    pad, poffs = _padded(buf, offs)
    ps, pe, row = word_spans(pad, poffs)
    if not len(ps):
        z = np.zeros(0, np.int64)
        return z, z, row, np.zeros((0, len(model.langs)), np.float32), z, z
    h = _trigrams(pad)
    score = np.add.reduceat(model.table[h], ps - 1, axis=0)
    scripts = np.maximum.reduceat(_scripts(pad), ps)
    return ps - 1 - row, pe - 1 - row, row, score.astype(np.float32), pe - ps, scripts


def viterbi(score: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Best state of each word for many documents at once, where a change of state costs ``penalty``.

    ``score`` is (words, states); document d has the words ``first[d] : first[d] + count[d]``. The
    documents advance together, one word a step, the longest first. Of equal states the first wins,
    and staying wins over switching.
    """
    out = np.zeros(len(score), np.int64)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    n = int(np.searchsorted(-count, 0, side="left"))
    first, count = first[:n], count[:n]
    if n == 0:
        return out
    steps = int(count[0])
    active = np.searchsorted(-count, -np.arange(steps), side="left")  # documents with more than t words
    moved = np.zeros(score.shape, bool)
    source = np.zeros(len(score), np.uint8)
    v = score[first].copy()
    last = v.copy()
    for t in range(1, steps):
        na = active[t]
        if na < len(v):
            last[na : len(v)] = v[na:]
            v = v[:na]
        at = first[:na] + t
        arg = v.argmax(1)
        jump = v[np.arange(na), arg] - np.float32(penalty)
        go = jump[:, None] > v
        moved[at] = go
        source[at] = arg
        v = np.where(go, jump[:, None], v) + score[at]
    last[: len(v)] = v
    state = last.argmax(1)
    for t in range(steps - 1, 0, -1):
        na = active[t]
        at = first[:na] + t
        now = state[:na]
        out[at] = now
        state[:na] = np.where(moved[at, now], source[at], now)
    out[first] = state
    return out


SPANS = "doc_id long, label string, share double, accepted boolean, mixed boolean, spans array<struct<start:int,end:int,lang:string>>"


def _identify(arr: pa.Array, model: LanguageModel, penalty: float) -> list[pa.Array]:
    """The columns of SPANS but the first."""
    buf, offs = text_buffer(arr)
    n = len(offs) - 1
    parts, base = [], 0
    while base < n:  # the trigram arrays of one part stay in cache
        to = max(base + 1, int(np.searchsorted(offs, offs[base] + (1 << 20), side="right")) - 1)
        s, e, row, sc, grams, script = word_scores(buf[offs[base] : offs[to]], offs[base : to + 1] - offs[base], model)
        parts.append((s + offs[base], e + offs[base], row + base, sc, grams, script))
        base = to
    s, e, row, score, grams, script = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 6
    L = len(model.langs)
    langs = list(model.langs)
    present = np.bincount(script, minlength=len(SCRIPTS)) > 0 if len(s) else np.zeros(len(SCRIPTS), bool)
    extra = [i for i in range(2, len(SCRIPTS)) if present[i] and not model.allowed[i].any()]
    states = np.zeros((len(s), L + len(extra)), np.float32)
    states[:, :L] = score.reshape(len(s), L)
    for j, sid in enumerate(extra):
        langs.append(SCRIPT_LANGUAGE[SCRIPTS[sid]])
        states[:, L + j] = np.where(script == sid, 0, FORBIDDEN)
    for sid in np.flatnonzero(present):
        if sid >= 1 and len(s):
            ok = np.zeros(len(langs), bool)
            ok[:L] = model.allowed[sid]
            ok[L:] = [x == sid for x in extra]
            if ok.any() and not ok.all():
                states[np.ix_(script == sid, ~ok)] = FORBIDDEN
    if len(s):  # words without letters favour nobody; so states that other documents bring in change nothing here
        states[script == 0, :] = 0
    count = np.bincount(row, minlength=n) if len(s) else np.zeros(n, np.int64)
    first = np.zeros(n, np.int64)
    np.cumsum(count[:-1], out=first[1:])
    path = viterbi(states, first, count, penalty)
    # labels by bytes of words with letters
    has = script > 0
    size = np.where(has, e - s, 0)
    by = np.bincount(row * len(langs) + path, weights=size, minlength=n * len(langs)).reshape(n, len(langs)) if len(s) else np.zeros((n, max(1, len(langs))))
    letters = by.sum(1)
    best = by.argmax(1)
    share = np.divide(by[np.arange(n), best], letters, out=np.zeros(n), where=letters > 0)
    own = np.where(path < L, score.reshape(len(s), L)[np.arange(len(s)), np.minimum(path, L - 1)], 0.0) if len(s) else np.zeros(0)
    fit = np.bincount(row, weights=np.where(has & (path < L), own, 0), minlength=n) if len(s) else np.zeros(n)
    seen = np.bincount(row, weights=np.where(has & (path < L), grams, 0), minlength=n) if len(s) else np.zeros(n)
    mean = np.divide(fit, seen, out=np.zeros(n), where=seen > 0)
    accepted = (letters > 0) & (mean > -TABLE_BITS * np.log(2))
    # spans: runs of one state
    new = np.ones(len(s), bool)
    if len(s):
        new[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(s)) - 1 if len(at) else at
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    r = row[at]
    struct = pa.StructArray.from_arrays(
        [pa.array((chars[s[at]] - chars[offs[r]]).astype(np.int32)), pa.array((chars[e[end]] - chars[offs[r]]).astype(np.int32)), pa.array(np.array(langs, object)[path[at]] if len(at) else [], pa.string())],
        names=["start", "end", "lang"],
    )
    runs = np.bincount(r, minlength=n) if len(at) else np.zeros(n, np.int64)
    list_offs = np.zeros(n + 1, np.int32)
    np.cumsum(runs, out=list_offs[1:])
    label = pa.array([langs[b] if ok else None for b, ok in zip(best.tolist(), (letters > 0).tolist())], pa.string())
    mixed = (by >= 0.1 * np.maximum(letters, 1)[:, None]).sum(1) > 1
    return [label, pa.array(share), pa.array(accepted), pa.array(mixed), pa.ListArray.from_arrays(pa.array(list_offs), struct)]


def train(docs: DataFrame, per_lang: int = TRAIN_DOCS_PER_LANG) -> LanguageModel:
    """Fit trigram tables on at most ``per_lang`` documents of each value of ``lang``, chosen by a hash of their ids."""
    rows = bounded_sample(docs.where("text is not null").select("doc_id", "lang", "text"), "lang", "doc_id", per_lang).select("lang", "text").toPandas()
    langs = tuple(sorted(rows["lang"].unique())) if len(rows) else ()
    size = 1 << TABLE_BITS
    if not langs:
        return LanguageModel(("und",), np.zeros((size + 1, 1), np.float32), np.ones((len(SCRIPTS), 1), bool))
    table = np.zeros((size + 1, len(langs)), np.float32)
    allowed = np.zeros((len(SCRIPTS), len(langs)), bool)
    for j, lang in enumerate(langs):
        count, scripts = np.zeros(size + 1), np.zeros(len(SCRIPTS))
        for text in rows["text"][rows["lang"] == lang]:
            pad, _ = _padded(*text_buffer(pa.array([text])))
            count += np.bincount(_trigrams(pad), minlength=size + 1)
            scripts += np.bincount(_scripts(pad), minlength=len(SCRIPTS))
        table[:size, j] = np.log((count[:size] + 0.5) / (count[:size].sum() + 0.5 * size))
        allowed[:, j] = scripts >= SCRIPT_SHARE * max(1.0, scripts[1:].sum())
    allowed[0] = True
    return LanguageModel(langs, table, allowed)


def identify_languages(docs: DataFrame, model: LanguageModel | None = None, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Label the language spans of every document.

    A word's letters fix its script, and a script admits the languages that use it in training (2 % of
    their letters at least); scripts that no trained language uses stand for a language of their own.
    Words score by the log-probability of their byte trigrams, and Viterbi joins them to spans, where
    each change costs ``penalty``.

    Returns ``(doc_id, label, share, accepted, mixed, spans)`` for every row: the language of most bytes of
    words and its share, and spans of code-point offsets; words without letters go with their neighbours, and a row's
    result doesn't depend on the rows beside it. A document is rejected if it has no letters
    (null, empty, only digits and signs: label null, share 0) or if its words fit their language worse
    than trigrams drawn at random. Rows repeat as they do in the input; without any labelled row
    all Latin text is "und".
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            yield pa.record_batch([b.column("doc_id"), *_identify(b.column("text"), shared.value, penalty)], names=["doc_id", "label", "share", "accepted", "mixed", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), SPANS)


def keep_identified(docs: DataFrame, model: LanguageModel | None = None, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The documents that ``identify_languages`` accepts, with ``lang`` set to the label found."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    schema = docs.select(*DOC_COLUMNS).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            label, _, accepted, _, _ = _identify(b.column("text"), shared.value, penalty)
            b = b.set_column(b.schema.get_field_index("lang"), "lang", label)
            yield b.filter(accepted)

    return docs.select(*DOC_COLUMNS).mapInArrow(tidy(run), schema)


def op8_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))
