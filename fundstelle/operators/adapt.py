"""Markers as scored citations: ``p_001`` ids, spans of a multi-section marker's parts, and case spans with their court."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundstelle.functions.dialect import fixed, let
from fundstelle.operators.law import split_spans
from fundstelle.schema import span

REACH, WIDEST_GAP = 100, 60
_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
#: What may stand between a court and its file number.
CONTEXT = rf"(?iu)(?:(?:Vorlage)?Beschluss|(?:Zwischen)?Urteil|Urt|Beschl|Gerichtsbescheid|vom|v\.|[-–]|[0-9]{{1,2}}\.\s*(?:{_MONTHS})|[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{2,4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})"


def expand_case(marker: Column, court: Column, text: Column) -> Column:
    """The marker's span from the nearest mention of its court on, if what stands between is short, closed, free of other numbers and like a citation."""
    own = span(marker["start"], marker["end"], marker["text"])
    from_ = F.greatest(F.lit(0), marker["start"] - REACH)
    before = F.substr(text, from_ + 1, marker["start"] - from_)
    parts = F.split(before, F.concat(F.lit("\\Q"), court, F.lit("\\E(?![A-Za-zÄÖÜäöüß])")), -1)
    between = F.element_at(parts, -1)

    def widened(b: Column) -> Column:
        start = marker["start"] - F.length(b) - F.length(court)
        closed = ~b.contains("(") | b.contains(")")
        alone = ~b.rlike(r"[0-9]+\s+[A-Z][a-zA-Z]{0,4}\s+[0-9]+[./]")
        bare = F.length(F.regexp_replace(b, "^[ ,;.:–-]+|[ ,;.:–-]+$", ""))
        fits = (F.length(b) <= WIDEST_GAP) & closed & alone & (b.rlike(CONTEXT) | (bare <= 3))
        return F.when(fits, span(start, marker["end"], F.substr(text, start + 1, marker["end"] - start))).otherwise(own)

    known = F.coalesce(court, F.lit("")) != ""
    return F.when(known & (F.size(parts) > 1), let(between, widened)).otherwise(own)


def markers_to_citations(df: DataFrame) -> DataFrame:
    """Citation rows ``(doc_id, ord, id, type, kind, start, end, text, book, number, court, file_number)`` of documents with ``text`` and ``markers``.

    Ids count through the document. A marker without references becomes one row of type ``unknown``.
    """
    m = F.col("m")
    rows = df.select("doc_id", F.col("text").alias("__text"), F.posexplode("markers").alias("mi", "m"))
    none = F.array(F.lit(None).cast("struct<book:string,section:string,court:string,file_number:string>"))
    rows = fixed(rows, "__spans", split_spans(m)).select("doc_id", "__text", "mi", "m", "__spans", F.posexplode(F.when(F.size("m.refs") > 0, F.col("m.refs")).otherwise(none)).alias("ri", "r"))
    law, case = F.col("r.section").isNotNull(), F.col("r.file_number").isNotNull()
    whole = span(m["start"], m["end"], m["text"])
    where = F.when(law & (F.size("m.refs") > 1), F.get("__spans", F.col("ri"))).when(case, expand_case(m, F.col("r.court"), F.col("__text"))).otherwise(whole)
    w = Window.partitionBy("doc_id").orderBy("mi", "ri")
    e = lambda c: F.nullif(F.col(c), F.lit(""))
    out = fixed(rows, "s", where).withColumn("ord", F.row_number().over(w))
    return out.select(
        "doc_id", "ord", F.format_string("p_%03d", "ord").alias("id"), F.when(law, "law").when(case, "case").otherwise("unknown").alias("type"), F.lit("full").alias("kind"),
        F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("text"), e("r.book").alias("book"), e("r.section").alias("number"), e("r.court").alias("court"), e("r.file_number").alias("file_number"),
    )
