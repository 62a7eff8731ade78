"""Readers of annotated corpora."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundstelle.operators.normalize import with_normalized
from fundstelle.schema import CITATION, RELATION

DOCUMENT = "doc_id string, format string, raw string, text string, language string, source string, source_profile string, court string, decision_type string, decision_date string"
CITATIONS, RELATIONS = f"array<{CITATION}>", f"array<{RELATION}>"


def data_dir(path: str | None = None) -> str:
    """The folder given, or that of ``CITATION_DATA_DIR``, or ``data/annotated``."""
    return path or os.environ.get("CITATION_DATA_DIR") or "data/annotated"


def make_documents(spark: SparkSession, texts: list[str] | list[tuple[str, str]], fmt: str | None = None) -> DataFrame:
    """Documents from strings, or from pairs of id and string; the format is detected where none is given."""
    rows = [(f"{i}", t) if isinstance(t, str) or t is None else t for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id string, raw string")
    return with_normalized(df.withColumn("format", F.lit(fmt)) if fmt else df)


def with_defaults(citations: Column) -> Column:
    """Citations as read from JSON, with the defaults of what is missing."""
    from fundstelle.schema import with_fields

    return F.transform(
        F.coalesce(citations, F.array().cast(CITATIONS)),
        lambda c: with_fields(c, kind=F.coalesce(c["kind"], F.lit("full")), confidence=F.coalesce(c["confidence"], F.lit(1.0)), structure=F.coalesce(c["structure"], F.create_map().cast("map<string,string>"))),
    )


def parse_annotations(df: DataFrame) -> DataFrame:
    """``citations`` and ``relations`` from JSON strings, with defaults; unreadable ones are empty."""
    relations = F.coalesce(F.from_json("relations", RELATIONS), F.array().cast(RELATIONS))
    return df.withColumn("citations", with_defaults(F.from_json("citations", CITATIONS))).withColumn("relations", relations)


def read_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """``documents.jsonl`` with the annotations of ``annotations.jsonl``, if there; of several for a document the last line counts."""
    docs = spark.read.schema(DOCUMENT).json(f"{folder}/documents.jsonl")
    path = f"{folder}/annotations.jsonl"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return docs.withColumn("citations", F.lit(None).cast(CITATIONS)).withColumn("relations", F.lit(None).cast(RELATIONS))
    notes = spark.read.schema(f"doc_id string, citations {CITATIONS}, relations {RELATIONS}").json(path)
    notes = notes.withColumn("__order", F.monotonically_increasing_id())
    last = notes.groupBy("doc_id").agg(F.max_by(F.struct("citations", "relations"), "__order").alias("a"))
    return docs.join(last, "doc_id", "left").select(*docs.columns, F.when(F.col("a").isNotNull(), with_defaults(F.col("a.citations"))).alias("citations"), F.when(F.col("a").isNotNull(), F.coalesce("a.relations", F.array().cast(RELATIONS))).alias("relations"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A table of documents whose ``citations`` and ``relations`` are JSON strings."""
    return parse_annotations(spark.read.parquet(path))


def load_dataset(spark: SparkSession, folder: str, split: str = "test") -> DataFrame:
    """``<folder>/<split>.parquet``, or the JSON lines of ``<folder>/<split>`` (``validation`` is ``dev``), or those of the folder itself."""
    jvm_path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()

    def exists(p: str) -> bool:
        q = jvm_path(p)
        return q.getFileSystem(conf).exists(q)

    if exists(f"{folder}/{split}.parquet"):
        return read_parquet(spark, f"{folder}/{split}.parquet")
    if exists(f"{folder}/dataset.parquet"):
        raise ValueError(f"no split {split} in {folder}")
    for place in (f"{folder}/{'dev' if split == 'validation' else split}", folder):
        if exists(f"{place}/documents.jsonl"):
            return read_jsonl(spark, place)
    raise FileNotFoundError(f"no documents in {folder}")


def read_bio(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """BIO training records; ``limit`` keeps the first ones by id."""
    df = spark.read.schema("doc_id string, tokens array<string>, ner_tags array<string>").json(path)
    return df.orderBy("doc_id").limit(limit) if limit is not None else df


def citation_ranks(rows: DataFrame) -> DataFrame:
    """Number citations ``p_001``, ``p_002`` … through a document in the order of ``ord``."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    return rows.withColumn("id", F.format_string("p_%03d", F.row_number().over(w)))
