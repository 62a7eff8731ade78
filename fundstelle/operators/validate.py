"""Checks of an annotated corpus; each gives the violations it finds as ``(check, doc_id, detail)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundstelle.functions.dialect import slice_text
from fundstelle.schema import KINDS, RELATIONS

TYPES = ("law", "case")
STRUCTURE = ("absatz", "abschnitt", "alternative", "buch", "buchstabe", "halbsatz", "kapitel", "nummer", "satz", "teil", "titel", "unterabschnitt", "unterkapitel", "untertitel", "variante")


def _found(df: DataFrame, check: str, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.col("doc_id").cast("string").alias("doc_id"), detail.cast("string").alias("detail"))


def unique_documents(docs: DataFrame) -> DataFrame:
    return _found(docs.groupBy("doc_id").count().where("count > 1"), "doc_id", F.concat(F.lit("appears "), F.col("count"), F.lit(" times")))


def matching_documents(docs: DataFrame, annotated: DataFrame) -> DataFrame:
    """Annotations of unknown documents."""
    return _found(annotated.select("doc_id").distinct().join(docs.select("doc_id").distinct(), "doc_id", "left_anti"), "join", F.lit("annotations without a document"))


def missing_annotations(docs: DataFrame, annotated: DataFrame) -> DataFrame:
    """Documents without annotations: a warning, no violation."""
    return _found(docs.select("doc_id").join(annotated.select("doc_id").distinct(), "doc_id", "left_anti"), "warning", F.lit("no annotations"))


def unique_citations(citations: DataFrame) -> DataFrame:
    return _found(citations.groupBy("doc_id", "id").count().where("count > 1"), "citation_id", F.col("id"))


def sound_spans(docs: DataFrame, citations: DataFrame) -> DataFrame:
    """Spans outside of the text, or with another text than stands there."""
    both = citations.join(docs.select("doc_id", F.col("text").alias("__text")), "doc_id").where("__text is not null")
    outside = (F.col("start") < 0) | (F.col("end") > F.length("__text"))
    wrong = ~slice_text(F.col("__text"), F.col("start"), F.col("end")).eqNullSafe(F.col("text"))
    what = F.when(outside, F.concat(F.lit("out of bounds: "), F.col("id"))).when(wrong, F.concat(F.lit("text differs: "), F.col("id")))
    return _found(both.where(outside | wrong), "span", what)


def vocabularies(citations: DataFrame, relations: DataFrame) -> DataFrame:
    bad = lambda c, ok: ~F.coalesce(F.col(c), F.lit("")).isin(*ok)
    parts = [
        _found(citations.where(bad("type", TYPES)), "type", F.concat_ws(": ", "id", "type")),
        _found(citations.where(bad("kind", KINDS)), "kind", F.concat_ws(": ", "id", "kind")),
        _found(relations.where(bad("relation", RELATIONS)), "relation", F.concat_ws(": ", F.concat_ws("->", "source_id", "target_id"), "relation")),
    ]
    if "structure" in citations.columns:
        keys = citations.select("doc_id", "id", F.explode(F.map_keys("structure")).alias("key"))
        parts.append(_found(keys.where(bad("key", STRUCTURE)), "structure", F.concat_ws(": ", "id", "key")))
    return reduce(DataFrame.union, parts)


def resolved_targets(citations: DataFrame) -> DataFrame:
    ids = citations.select("doc_id", F.col("id").alias("resolves_to")).distinct()
    return _found(citations.where("resolves_to is not null").join(ids, ["doc_id", "resolves_to"], "left_anti"), "resolves_to", F.concat_ws("->", "id", "resolves_to"))


def relation_ends(citations: DataFrame, relations: DataFrame) -> DataFrame:
    ids = citations.select("doc_id", F.col("id").alias("__id")).distinct()
    ends = relations.select("doc_id", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source_id").alias("__id")), F.struct(F.lit("target").alias("side"), F.col("target_id").alias("__id")))).alias("e")).select("doc_id", "e.*")
    return _found(ends.join(ids, ["doc_id", "__id"], "left_anti"), "relation_end", F.concat_ws(": ", "side", "__id"))


def validate(docs: DataFrame, citations: DataFrame, relations: DataFrame) -> DataFrame:
    """All violations of a corpus of documents ``(doc_id, text)``, citation rows and relation rows."""
    checks = [unique_documents(docs), matching_documents(docs, citations), unique_citations(citations), sound_spans(docs, citations), vocabularies(citations, relations), resolved_targets(citations), relation_ends(citations, relations)]
    return reduce(DataFrame.union, checks)
