"""Extraction from streams of JSON documents: per-row work only, so no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from fundstelle.operators.export import jsonl
from fundstelle.plans.pipeline import extract

DOCUMENT = "doc_id string, raw string"


def read_documents(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def extract_stream(docs: DataFrame, **options) -> DataFrame:
    return extract(docs, **options)


def write_jsonl(extracted: DataFrame, folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append a line of JSON for each document to text files, exactly once."""
    out = jsonl(extracted).select("value").writeStream.format("text").option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start(folder)
