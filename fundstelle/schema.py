"""Tables of this library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string>"
FIELDS = {
    "id": "string",
    "type": "string",
    "kind": "string",
    "span": SPAN,
    "confidence": "double",
    "source": "string",
    "unit": "string",
    "delimiter": "string",
    "book": "string",
    "number": "string",
    "structure": "map<string,string>",
    "range_end": "string",
    "range_extensions": "array<string>",
    "resolves_to": "string",
    "court": "string",
    "file_number": "string",
    "date": "string",
    "ecli": "string",
    "decision_type": "string",
    "reporter": "string",
    "reporter_volume": "string",
    "reporter_page": "string",
}
CITATION = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"
RELATION = f"struct<source_id:string,target_id:string,relation:string,span:{SPAN}>"
MARKER = "struct<phase:int,start:int,end:int,text:string,refs:array<struct<book:string,section:string,court:string,file_number:string>>>"
KINDS = tuple("aao ebenda full ibid id short supra".split())
RELATIONS = tuple("aao ebenda ivm parallel resolves_to siehe vgl".split())
STRUCTURE_KEYS = frozenset(
    "abschnitt absatz alternative anhang anlage buch buchstabe doppelbuchstabe halbsatz kapitel nummer satz spiegelstrich stufe tabelle teil titel unterabschnitt untertitel variante ziffer".split()
)


def citation(**fields: Column) -> Column:
    """A citation with the given fields; the others have their defaults."""
    defaults = {"kind": F.lit("full"), "confidence": F.lit(1.0), "source": F.lit("regex"), "structure": F.create_map(), "range_extensions": F.array()}
    values = {k: fields.get(k, defaults.get(k, F.lit(None))) for k in FIELDS}
    return F.struct(*[values[k].cast(t).alias(k) for k, t in FIELDS.items()])


def with_fields(c: Column, **fields: Column) -> Column:
    """The citation with some fields replaced."""
    return F.struct(*[(fields[k] if k in fields else c[k]).cast(t).alias(k) for k, t in FIELDS.items()])


def span(start: Column, end: Column, text: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"))


def citation_id(s: Column, source: Column | str = "regex", doc_id: Column | str = "") -> Column:
    """Twelve hexadecimal digits of a hash of where and what; unique within a document only, as callers leave ``doc_id`` out."""
    col = lambda v: F.lit(v) if isinstance(v, str) else v.cast("string")
    return F.substring(F.sha2(F.concat_ws("|", col(doc_id), s["start"].cast("string"), s["end"].cast("string"), s["text"], col(source)), 256), 1, 12)
