"""Evaluation of engines against gold annotations, and its report."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundstelle.operators import score
from fundstelle.operators.adapt import markers_to_citations
from fundstelle.plans.pipeline import Engine, citation_rows, extract, extract_markers, relation_rows

ENGINES = ("rules", "citations")


def flat(rows: DataFrame) -> DataFrame:
    """Citation rows with the span's parts as columns of their own."""
    rest = [c for c in rows.columns if c != "span"]
    return rows.select(*rest, F.col("span.start").alias("start"), F.col("span.end").alias("end"), F.col("span.text").alias("text"))


def gold_rows(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Law and case citations and the relations of documents that have annotations."""
    known = annotated.where("citations is not null")
    return flat(citation_rows(known)).where(F.col("type").isin("law", "case")), relation_rows(known.where("relations is not null"))


def predictions(annotated: DataFrame, engine: str = "rules", engines: Sequence[Engine] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Citation rows and relation rows of documents that have annotations.

    ``rules`` scores markers with their adapted spans and has no relations; ``citations`` scores the whole pipeline, or that of the given engines.
    """
    docs = annotated.where("citations is not null").select("doc_id", "text")
    if engine == "rules":
        return markers_to_citations(extract_markers(docs)), None
    if engine == "citations":
        done = extract(docs, engines, normalize=False)
        return flat(citation_rows(done)), relation_rows(done)
    raise ValueError(f"the engine is one of {', '.join(ENGINES)}")


def evaluate(annotated: DataFrame, engine: str = "rules", engines: Sequence[Engine] | None = None, limit: int | None = None) -> dict:
    """Scores of an engine over documents with ``text``, ``citations`` and ``relations``; ``limit`` keeps the first annotated documents by id.

    Predictions are computed once and kept for the scores that follow; only aggregated rows come to the driver.
    """
    if limit is not None:
        annotated = annotated.where("citations is not null").orderBy("doc_id").limit(limit)
    gold, gold_rel = gold_rows(annotated)
    pred, pred_rel = predictions(annotated, engine, engines)
    pred = pred.persist()
    began = time.time()
    try:
        n = pred.count()
        took = time.time() - began
        size = annotated.where("citations is not null").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()
        rows = lambda df, key: {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in df.collect()}
        out = {
            "engine": engine, "documents": size.n, "characters": int(size.c), "gold": gold.count(), "predicted": n,
            "exact": score.span_scores(gold, pred).first().asDict(), "by_type": rows(score.span_scores_by_type(gold, pred), "type"), "overlap": rows(score.overlap_scores(gold, pred), "type"),
            "fields": rows(score.field_accuracy(gold, pred), "field"), "fields_overlap": rows(score.field_accuracy_overlap(gold, pred), "field"),
            "seconds": round(took, 3), "documents_per_second": round(size.n / took, 2) if took else 0.0,
        }
        if pred_rel is not None:
            out["relations"] = score.relation_scores(gold, gold_rel, pred, pred_rel).first().asDict()
        return out
    finally:
        pred.unpersist()


def to_json(report: dict) -> str:
    return json.dumps(report, ensure_ascii=False, indent=2)


def to_text(report: dict) -> str:
    """A report for people."""

    def line(name: str, s: dict) -> str:
        return f"  {name:<14} P {s['precision']:.3f}  R {s['recall']:.3f}  F1 {s['f1']:.3f}  (tp {s['tp']}, fp {s['fp']}, fn {s['fn']})"

    out = [f"Engine {report['engine']}: {report['documents']} documents, {report['gold']} gold and {report['predicted']} predicted citations", "Spans", line("exact", report["exact"])]
    out += [line(f"exact {k}", s) for k, s in sorted(report["by_type"].items())] + [line(f"overlap {k}", s) for k, s in sorted(report["overlap"].items())]
    if "relations" in report:
        out.append(line("relations", report["relations"]))
    out.append("Fields")
    out += [f"  {k:<22} {s['accuracy']:.3f}  (correct {s['correct']}, incorrect {s['incorrect']}, only gold {s['missing_pred']}, only predicted {s['missing_gold']})" for k, s in sorted({**report["fields"], **report["fields_overlap"]}.items())]
    out.append(f"{report['documents_per_second']:.1f} documents a second in {report['seconds']:.1f} s")
    return "\n".join(out)
