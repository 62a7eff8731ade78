"""``spark-submit`` entry points: ``python -m fundstelle extract|evaluate|validate|diagnose|bio …``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fundstelle.operators import diagnose, tokens, validate
from fundstelle.operators.export import jsonl
from fundstelle.plans import report
from fundstelle.plans.pipeline import extract
from fundstelle.sources.datasets import data_dir, load_dataset


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fundstelle")
    parser.add_argument("command", choices=("extract", "evaluate", "validate", "diagnose", "bio"))
    parser.add_argument("--data", help="folder of an annotated corpus, or, for extract, JSON lines of doc_id and raw")
    parser.add_argument("--split", default="test")
    parser.add_argument("--engine", default="rules", choices=report.ENGINES)
    parser.add_argument("--limit", type=int)
    parser.add_argument("--out", help="folder to write to")
    parser.add_argument("--json", help="print JSON", action="store_true")
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("fundstelle").getOrCreate()
    if a.command == "extract":
        docs = spark.read.schema("doc_id string, raw string").json(data_dir(a.data))
        jsonl(extract(docs)).select("value").write.text(a.out)
        return 0
    corpus = load_dataset(spark, data_dir(a.data), a.split)
    if a.command == "bio":
        records = tokens.bio_records(corpus.where("citations is not null"))
        records.write.json(a.out)
        print(tokens.bio_statistics(records).first().asDict())
        return 0
    if a.command == "evaluate":
        found = report.evaluate(corpus, a.engine, limit=a.limit)
        print(report.to_json(found) if a.json else report.to_text(found))
        return 0
    known = corpus.where("citations is not null")
    if a.command == "validate":
        docs = corpus.select("doc_id", "text")
        for r in validate.missing_annotations(docs, known).orderBy("doc_id").toLocalIterator():
            print(f"warning: {r.doc_id}: {r.detail}", file=sys.stderr)
        bad = validate.validate(docs, report.flat(report.citation_rows(known)), report.relation_rows(known.where("relations is not null")))
        n = 0
        for r in bad.orderBy("check", "doc_id", "detail").toLocalIterator():
            n += 1
            print(f"{r.check}: {r.doc_id}: {r.detail}")
        return int(n > 0)
    gold, _ = report.gold_rows(corpus)
    pred, _ = report.predictions(corpus, a.engine)
    missed, invented = diagnose.missed(gold, pred), diagnose.invented(gold, pred)
    for title, rows in (("missed", missed), ("invented", invented)):
        print(title, {r["type"]: r.n for r in diagnose.by_type(rows).orderBy(F.desc("n"), "type").collect()})
        print("  books", {r.book: r.n for r in diagnose.top_books(rows).collect()})
        for r in diagnose.examples(rows, 15).orderBy("type", "doc_id", "start").collect():
            print(f"  {r['type']} {r.doc_id}: {r.text}")
    print("file numbers", diagnose.number_shapes(missed).first().asDict())
    print("near misses", diagnose.near_misses(gold, pred).count())
    return 0


if __name__ == "__main__":
    sys.exit(main())
