"""Quality scores by co-training: a text view and a metadata view that label documents for each other."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, documents, pieces, release, summed, text_buffer, tidy, written

#: The fit reads so many labelled documents of each class at most.
TRAIN_DOCS_PER_CLASS = 1500
HELD_OUT_SHARE = 0.25
ROUNDS = 3
ADDED_PER_ROUND = 300
CONFIDENCE = 0.95
TEXT_DIMS = 1024
PRIOR = 300.0
HASHED = 64
META_DIMS = 2 * HASHED + 6


def trigram_counts(arr: pa.Array) -> np.ndarray:
    """Counts of hashed byte trigrams, case and signs kept, for each text."""
    buf, offs = text_buffer(arr)
    n = len(offs) - 1
    if len(buf) < 3:
        return np.zeros((n, TEXT_DIMS), np.float32)
    x = np.maximum(buf, 32).astype(np.uint32)
    h = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(22)
    row = np.repeat(np.arange(n), np.diff(offs))
    inside = row[:-2] == row[2:]
    count = np.bincount(row[:-2][inside] * TEXT_DIMS + h[inside], minlength=n * TEXT_DIMS).reshape(n, TEXT_DIMS)
    return count.astype(np.float32)


def text_features(count: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Square roots of the trigrams' shares, less those of the usual shares.

    Every text gets ``PRIOR`` further trigrams in the usual shares, so little text makes little evidence.
    """
    share = (count + PRIOR * mean) / (count.sum(1, keepdims=True) + PRIOR)
    return (np.sqrt(share) - np.sqrt(mean)).astype(np.float32)


def metadata_features(source: list, lang: list, n_chars: list, lines: np.ndarray) -> np.ndarray:
    """Hashed source and language, size and layout; what is null has a place of its own."""
    n = len(source)
    out = np.zeros((n, META_DIMS), np.float32)
    for base, values in ((0, source), (HASHED, lang)):
        slot = {v: HASHED - 1 if v is None else int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") % (HASHED - 1) for v in set(values)}
        out[np.arange(n), [base + slot[v] for v in values]] = 1
    size = np.array([np.nan if v is None else v for v in n_chars], np.float64)
    known = ~np.isnan(size)
    size = np.where(known, np.maximum(size, 0), 0)
    log = np.log1p(size) / 10
    per_line = np.log1p(size / np.maximum(lines, 1)) / 10
    out[:, 2 * HASHED :] = np.stack([log, log**2, np.log1p(lines) / 10, per_line, per_line**2, ~known], axis=1)
    return out


def _lines(arr: pa.Array) -> np.ndarray:
    buf, offs = text_buffer(arr)
    ends = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(buf == 10, out=ends[1:])
    return ends[offs[1:]] - ends[offs[:-1]] + (np.diff(offs) > 0)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3, steps: int = 12) -> np.ndarray:
    """Weights and intercept of a ridge logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * w
        s = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(x.dtype) + x.dtype.type(w[-1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class QualityModel:
    text: np.ndarray
    meta: np.ndarray
    platt: tuple[np.ndarray, np.ndarray]  # slope and intercept of each view
    prior: float  # log-odds of good documents
    mean: np.ndarray  # usual shares of the trigrams
    added: list[int] = field(default_factory=list)  # pseudo-labels taken over in each round


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, held: np.ndarray, mean: np.ndarray, pool: Callable, rounds: int = ROUNDS, per_round: int = ADDED_PER_ROUND, confidence: float = CONFIDENCE, totals: tuple[int, int] | None = None) -> QualityModel:
    """Fit both views on labelled rows; ``y`` is 0 or 1, and the rows of ``held`` calibrate and are never trained on.

    In each round either view gives the other the unlabelled documents of ``pool`` that it is surest of,
    ``per_round`` at most and in the classes' proportion, if their calibrated probability is ``confidence`` or more; they count half a label.
    ``pool(fitted, quotas, confidence, given)`` returns, for either view and label, the ids and both views' features of those.
    ``totals`` has the bad and the good documents of the whole table, of which the labelled rows are a sample by class:
    calibration, prior and the classes' proportion are the table's.
    """
    balance = lambda t, w: w * np.where(t == 1, 0.5 / max(1e-9, (w * (t == 1)).sum()), 0.5 / max(1e-9, (w * (t == 0)).sum())) * w.sum()
    base, cal = np.flatnonzero(~held), np.flatnonzero(held)
    views = [xt, xm]
    extra: list[dict[int, tuple[int, np.ndarray]]] = [{}, {}]
    sampled = np.array([(y == 0).sum(), (y == 1).sum()], np.float64)
    real = sampled if totals is None else np.asarray(totals, np.float64)
    stands = real / np.maximum(sampled, 1)  # documents of the table for each labelled row
    stands *= sampled.sum() / max(1e-9, (stands * sampled).sum())
    weighed = lambda rows: float(np.average(y[rows], weights=stands[y[rows]]))
    share = weighed(base) if len(base) else 0.5
    quotas = {1: round(per_round * share), 0: round(per_round * (1 - share))}
    added = []

    def fit(v: int) -> tuple[np.ndarray, np.ndarray]:
        more = [extra[v][i] for i in sorted(extra[v])]
        x = np.vstack([views[v][base], *[r[None] for _, r in more]])
        target = np.concatenate([y[base], [label for label, _ in more]]).astype(np.float64)
        weight = np.concatenate([np.ones(len(base)), np.full(len(more), 0.5)])
        w = fit_logistic(x, target, balance(target, weight))
        if len(np.unique(y[cal])) < 2:
            return w, np.array([1.0, 0.0])
        return w, fit_logistic(logits(views[v][cal], w)[:, None], y[cal].astype(np.float64), stands[y[cal]], ridge=1e-3)

    fitted = [fit(0), fit(1)]
    for _ in range(rounds):
        count = 0
        for (v, label), rows in pool(fitted, quotas, confidence, [sorted(extra[1]), sorted(extra[0])]).items():
            for i, own in rows:
                extra[1 - v][i] = (label, own[1 - v])
            count += len(rows)
        added.append(count)
        if not count:
            break
        fitted = [fit(0), fit(1)]
    prior = float(np.clip(weighed(cal), 0.01, 0.99)) if len(cal) else share
    return QualityModel(fitted[0][0].astype(np.float32), fitted[1][0].astype(np.float32), (fitted[0][1], fitted[1][1]), float(np.log(prior / (1 - prior))), mean.astype(np.float32), added)


def _meta_of(b: pa.RecordBatch) -> np.ndarray:
    return metadata_features(b.column("source").to_pylist(), b.column("lang").to_pylist(), b.column("n_chars").to_pylist(), _lines(b.column("text")))


def _document_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))


def usual_shares(rows: DataFrame) -> np.ndarray:
    """The share of each hashed trigram in all texts."""

    def count(b: pa.RecordBatch) -> np.ndarray:
        return sum((trigram_counts(p.column("text")).sum(0, dtype=np.float64) for p in pieces(iter([b]), "text", 2 << 20)), np.zeros(TEXT_DIMS))

    total = summed(rows.select("text"), count, TEXT_DIMS) + 1
    return total / total.sum()


def _fetched(rows: DataFrame, ids: DataFrame, mean: np.ndarray) -> pd.DataFrame:
    """Both views' features of a bounded number of documents, each once (of repeated ids, the least features)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            xt, xm = text_features(trigram_counts(b.column("text")), mean), _meta_of(b)
            yield pa.record_batch([b.column("doc_id"), pa.array([r.tobytes() for r in xt], pa.binary()), pa.array([r.tobytes() for r in xm], pa.binary())], names=["doc_id", "xt", "xm"])

    wanted = rows.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text", "source", "lang", "n_chars")
    got = wanted.mapInArrow(tidy(features), "doc_id long, xt binary, xm binary").toPandas().sort_values(["doc_id", "xt", "xm"]).drop_duplicates("doc_id")
    got["xt"] = [np.frombuffer(r, np.float32) for r in got["xt"]]
    got["xm"] = [np.frombuffer(r, np.float32) for r in got["xm"]]
    return got


def training_set(docs: DataFrame, labels: DataFrame, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """Text and metadata features, labels and the held-out rows of a sample of the labelled documents, and the whole table's bad and good documents."""
    marked = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(known_labels(labels), "doc_id")
    count = {r[0]: r[1] for r in marked.groupBy("y").count().collect()}
    totals = (count.get(0, 0), count.get(1, 0))
    held = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1000)) < int(1000 * HELD_OUT_SHARE)
    picked = bounded_sample(marked, "y", "doc_id", TRAIN_DOCS_PER_CLASS).select("doc_id", "y", held.alias("held")).toPandas()
    ids = docs.sparkSession.createDataFrame(picked[["doc_id"]], "doc_id long")
    got = picked.merge(_fetched(_document_rows(docs), ids, mean), on="doc_id").sort_values("doc_id")
    if not len(got):
        return np.zeros((0, TEXT_DIMS), np.float32), np.zeros((0, META_DIMS), np.float32), np.zeros(0, np.int64), np.zeros(0, bool), totals
    return np.stack(got["xt"].tolist()), np.stack(got["xm"].tolist()), got["y"].to_numpy(np.int64), got["held"].to_numpy(bool), totals


def known_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, y)``, each id once; of conflicting labels the lower one counts."""
    return labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))


def whole_table_pool(docs: DataFrame, labels: DataFrame, mean: np.ndarray):
    """``co_train``'s pool over all unlabelled documents: both views score them where they are, and only the ids of those that
    reach the confidence are written, to be cut to the quota; of equally sure ones (to 3 digits of the log-odds) an order by a hash of the ids decides."""
    rows, known = _document_rows(docs).where("doc_id is not null"), known_labels(labels).select("doc_id")

    def pool(fitted, quotas: dict[int, int], confidence: float, given: list[list[int]]):
        shared = docs.sparkSession.sparkContext.broadcast((fitted, mean))
        edge = float(np.log(confidence / (1 - confidence)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            views, usual = shared.value
            for b in pieces(batches, "text", 2 << 20):
                z = [logits(x, w).astype(np.float64) * platt[0] + platt[1] for x, (w, platt) in zip((text_features(trigram_counts(b.column("text")), usual), _meta_of(b)), views)]
                yield pa.record_batch([b.column("doc_id"), pa.array(z[0]), pa.array(z[1])], names=["doc_id", "z0", "z1"]).filter(pa.array((np.abs(z[0]) >= edge) | (np.abs(z[1]) >= edge)))

        sure = rows.mapInArrow(tidy(run), "doc_id long, z0 double, z1 double").join(known, "doc_id", "left_anti")
        sure = written(sure.groupBy("doc_id").agg(F.min("z0").alias("z0"), F.min("z1").alias("z1")))
        chosen: dict[tuple[int, int], list[int]] = {}
        for v in (0, 1):
            for label in (1, 0):
                z = F.col(f"z{v}") * (1 if label else -1)
                left = sure.where((z >= edge) & ~F.col("doc_id").isin(given[v])) if given[v] else sure.where(z >= edge)
                chosen[v, label] = [r[0] for r in left.orderBy(F.round(z, 3).desc(), F.xxhash64("doc_id"), "doc_id").limit(quotas[label]).select("doc_id").collect()]
        release(sure)
        ids = sorted({i for x in chosen.values() for i in x})
        if not ids:
            return {}
        got = _fetched(rows, docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long"), mean)
        own = {i: (t, m) for i, t, m in zip(got["doc_id"], got["xt"], got["xm"])}
        return {key: [(i, own[i]) for i in x] for key, x in chosen.items()}

    return pool


SCORES = "doc_id long, p_text double, p_meta double, score double, keep boolean"


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, p_text, p_meta, score, keep)`` for every row of ``docs``.

    Two logistic regressions, on trigrams of the whole text and on metadata (source, language, size and
    layout), are co-trained on ``TRAIN_DOCS_PER_CLASS`` labelled documents of each class at most and on pseudo-labels: in each
    round either view takes over the documents that the other is surest of among all without a label. They are calibrated on
    a quarter of the labelled ones that neither trains on, weighted to the classes' counts in the whole table; ``score`` is the probability that both give if they are independent in
    either class: their log-odds add, less the prior's.
    ``keep`` is a score of ``threshold`` or more.

    Null and empty texts have no trigrams and are scored by the intercept and their metadata; null metadata have
    features of their own. Of conflicting labels the lower one counts; labels other than 0 and 1, and of unknown ids, are ignored.
    Without labels of both classes all scores are null and all documents are kept.
    """
    model = None
    mean = usual_shares(_document_rows(docs))
    xt, xm, y, held, totals = training_set(docs, labels, mean)
    if len(np.unique(y[~held])) == 2:
        model = co_train(xt, xm, y, held, mean, whole_table_pool(docs, labels, mean), totals=totals)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in pieces(batches, "text", 2 << 20):
            n = b.num_rows
            if m is None:
                none = pa.nulls(n, pa.float64())
                cols = [none, none, none, pa.array(np.ones(n, bool))]
            else:
                zt = logits(text_features(trigram_counts(b.column("text")), m.mean), m.text) * m.platt[0][0] + m.platt[0][1]
                zm = logits(_meta_of(b), m.meta) * m.platt[1][0] + m.platt[1][1]
                s = sigmoid(zt + zm - m.prior)
                cols = [pa.array(x.astype(np.float64)) for x in (sigmoid(zt), sigmoid(zm), s)] + [pa.array(s >= threshold)]
            yield pa.record_batch([b.column("doc_id"), *cols], names=["doc_id", "p_text", "p_meta", "score", "keep"])

    return _document_rows(docs).mapInArrow(tidy(run), SCORES)


def op10_co_trained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
