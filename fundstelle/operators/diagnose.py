"""Where predictions go wrong: misses and false alarms by type, book and shape, with examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundstelle.operators.score import last_by_span


def missed(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold rows of spans that nobody predicted."""
    return last_by_span(gold).join(last_by_span(pred).select("doc_id", "start", "end"), ["doc_id", "start", "end"], "left_anti")


def invented(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return missed(pred, gold)


def by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def top_books(rows: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` commonest books of law rows, of equally common ones the first in alphabetical order."""
    return rows.where("type = 'law' and coalesce(book, '') <> ''").groupBy("book").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "book").limit(k)


def number_shapes(rows: DataFrame) -> DataFrame:
    """How many file numbers have a slash, only a dot, only a hyphen, or begin with two capitals: one row."""
    x = F.col("file_number")
    slash, dot, dash = x.contains("/"), x.contains("."), x.contains("-")
    return rows.where("type = 'case' and coalesce(file_number, '') <> ''").agg(F.count_if(slash).alias("slash"), F.count_if(dot & ~slash).alias("dot"), F.count_if(dash & ~slash & ~dot).alias("dash"), F.count_if(x.rlike("^[A-Z]{2,}")).alias("capitals"))


def near_misses(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs of a missed and an invented citation of one type that overlap."""
    g = missed(gold, pred).select("doc_id", "type", F.col("start").alias("gold_start"), F.col("end").alias("gold_end"))
    p = invented(gold, pred).select("doc_id", "type", F.col("start").alias("pred_start"), F.col("end").alias("pred_end"))
    return g.join(p, ["doc_id", "type"]).where("gold_start < pred_end and pred_start < gold_end")


def examples(rows: DataFrame, per_type: int = 30) -> DataFrame:
    """The first rows of each type by document and place."""
    w = Window.partitionBy("type").orderBy("doc_id", "start", "end")
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_type).drop("__n")
