"""The corpus pipeline: language ID, line dedup, near dedup, mixing and tokenisation of ``documents``.

Each stage takes what the one before it wrote. ``run`` writes every stage but the last to the shared
folder, so a lost executor never costs more than a stage's own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fundstelle.llm.bpe import encode, token_count
from fundstelle.llm.common import DOC_COLUMNS, documents, written
from fundstelle.llm.langid import keep_identified
from fundstelle.llm.linededup import dedup_lines
from fundstelle.llm.mixing import mixed_documents
from fundstelle.llm.simhash import keep_one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language, which replaces ``lang``; those without letters or language go."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; one that loses all of them stays, empty."""
    return dedup_lines(docs.select(*DOC_COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id."""
    return keep_one_of_each(docs.select(*DOC_COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-length blocks of the sources' texts, drawn by weight; ``doc_id`` is the place in the mixture."""
    return mixed_documents(docs)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each block, checked by decoding."""
    return encode(docs).select("doc_id", token_count("ids").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixture", mixture),
    ("bpe_ids", bpe_ids),
]

#: SQL has neither Viterbi nor MinHash components; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
