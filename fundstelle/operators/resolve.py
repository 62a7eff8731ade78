"""Short forms and relations, as folds over a document's citations in order and as windows over citation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundstelle.functions.dialect import FLAGS, slice_text
from fundstelle.schema import CITATION, RELATION, with_fields
from fundstelle.sources.lexicon import REPORTER_COURT

LIST = f"array<{CITATION}>"
#: In order of precedence; ``i`` ignores case.
RELATION_PATTERNS = (
    ("ivm", r"(?iu)(?:in\s+Verbindung\s+mit|i[.]?\s*V[.]?\s*m[.]?)"),
    ("vgl", r"vgl\.?"),
    ("aao", r"(?:a[.]?\s*){2}O[.]?"),
    ("ebenda", r"(?iu)(?:ebd\.?|ebenda)"),
    ("siehe", r"siehe\s+dort"),
)


def _filled(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def _reporter_court(reporter: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in REPORTER_COURT.items() for x in kv]), reporter)


def resolve_law(citations: Column) -> Column:
    """Law citations without a book take that of the last law citation with one, and point to it."""

    def step(acc: Column, c: Column) -> Column:
        law = c["type"] == "law"
        full = law & _filled(c["book"])
        short = law & ~_filled(c["book"]) & acc["book"].isNotNull()
        new = F.when(short, with_fields(c, kind=F.lit("short"), book=acc["book"], resolves_to=acc["id"])).otherwise(c)
        return F.struct(F.when(full, c["book"]).otherwise(acc["book"]).alias("book"), F.when(full, c["id"]).otherwise(acc["id"]).alias("id"), F.concat(acc["out"], F.array(new)).alias("out"))

    none = F.lit(None).cast("string")
    return F.aggregate(citations, F.struct(none.alias("book"), none.alias("id"), F.array().cast(LIST).alias("out")), step)["out"]


def resolve_case(citations: Column) -> Column:
    """Reporter citations without a court, behind a full case citation of the reporter's court, take that court."""

    def step(acc: Column, c: Column) -> Column:
        case = c["type"] == "case"
        full = case & _filled(c["court"]) & _filled(c["file_number"]) & ~_filled(c["reporter"])
        court = _reporter_court(c["reporter"])
        short = case & _filled(c["reporter"]) & ~_filled(c["court"]) & F.coalesce(acc["court"].contains(court), F.lit(False))
        new = F.when(short, with_fields(c, kind=F.lit("short"), court=court)).otherwise(c)
        return F.struct(F.when(full, c["court"]).otherwise(acc["court"]).alias("court"), F.concat(acc["out"], F.array(new)).alias("out"))

    return F.aggregate(citations, F.struct(F.lit(None).cast("string").alias("court"), F.array().cast(LIST).alias("out")), step)["out"]


def relation_in(gap: Column) -> Column:
    """``struct<relation,at,text>`` of the first pattern that occurs in a text; null if none does."""
    none = F.lit(None).cast("struct<relation:string,at:int,text:string>")
    out = none
    for name, pattern in reversed(RELATION_PATTERNS):
        hit = F.struct(F.lit(name).alias("relation"), (F.regexp_instr(gap, F.lit(FLAGS + pattern)) - 1).cast("int").alias("at"), F.regexp_extract(gap, FLAGS + pattern, 0).alias("text"))
        out = F.when(gap.rlike(FLAGS + pattern), hit).otherwise(out)
    return out


def relations(citations: Column, text: Column) -> Column:
    """``array<RELATION>`` between neighbours, from what stands between them."""

    def pair(c: Column, i: Column) -> Column:
        nxt = F.get(citations, i + 1)
        gap = slice_text(text, c["span"]["end"], nxt["span"]["start"])
        r = F.when(c["span"]["end"] < nxt["span"]["start"], relation_in(gap))
        return F.struct(c["id"].alias("s"), nxt["id"].alias("t"), c["span"]["end"].alias("base"), r.alias("r"))

    found = F.filter(F.transform(citations, pair), lambda p: p["r"].isNotNull())

    def made(p: Column) -> Column:
        start = p["base"] + p["r"]["at"]
        return F.struct(p["s"].alias("source_id"), p["t"].alias("target_id"), p["r"]["relation"].alias("relation"), F.struct(start.alias("start"), (start + F.length(p["r"]["text"])).alias("end"), p["r"]["text"].alias("text")).alias("span"))

    return F.transform(found, made).cast(f"array<{RELATION}>")


def resolve_law_rows(rows: DataFrame) -> DataFrame:
    """``resolve_law`` over citation rows ``(doc_id, ord, type, id, book, kind, resolves_to, …)``, for batches."""
    w = Window.partitionBy("doc_id", "type").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    own = F.nullif(F.col("book"), F.lit(""))
    last = F.last(F.when(own.isNotNull(), F.struct(own.alias("book"), F.col("id").alias("id"))), True).over(w)
    short = (F.col("type") == "law") & own.isNull() & F.col("__last").isNotNull()
    out = rows.withColumn("__last", last)
    return out.withColumns({"resolves_to": F.when(short, F.col("__last.id")).otherwise(F.col("resolves_to")), "kind": F.when(short, "short").otherwise(F.col("kind")), "book": F.when(short, F.col("__last.book")).otherwise(F.col("book"))}).drop("__last")


def resolve_case_rows(rows: DataFrame) -> DataFrame:
    """``resolve_case`` over citation rows."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    full = (F.col("type") == "case") & _filled(F.col("court")) & _filled(F.col("file_number")) & ~_filled(F.col("reporter"))
    out = rows.withColumn("__c", F.last(F.when(full, F.col("court")), True).over(w)).withColumn("__r", _reporter_court(F.col("reporter")))
    short = (F.col("type") == "case") & _filled(F.col("reporter")) & ~_filled(F.col("court")) & F.coalesce(F.col("__c").contains(F.col("__r")), F.lit(False))
    return out.withColumn("__s", short).withColumns({"court": F.when(F.col("__s"), F.col("__r")).otherwise(F.col("court")), "kind": F.when(F.col("__s"), "short").otherwise(F.col("kind"))}).drop("__c", "__r", "__s")
