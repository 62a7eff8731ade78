"""Citations as JSON lines, spaCy, GLiNER, W3C annotations and Akoma Ntoso."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundstelle.functions.dialect import fixed, slice_text
from fundstelle.operators.tokens import tokens
from fundstelle.schema import CITATION, MARKER, RELATION

W3C = "http://www.w3.org/ns/" + "anno.jsonld"
_COMMON = ("id", "type", "kind", "span", "confidence", "source")
_LAW_ALWAYS = ("unit", "delimiter", "book", "number")
_LAW_IF_SET = ("structure", "range_end", "range_extensions", "resolves_to")
_CASE_IF_SET = ("court", "file_number", "date", "ecli", "decision_type", "reporter", "reporter_volume", "reporter_page")


def _set_only(c: Column, name: str) -> Column:
    v = c[name]
    if name in ("structure", "range_extensions"):
        return F.when(F.size(v) > 0, v).alias(name)
    return F.nullif(v, F.lit("")).alias(name)


def _objects(*parts: Column) -> Column:
    """One JSON object from the members of several."""
    inner = [F.nullif(F.substr(p, F.lit(2), F.length(p) - 2), F.lit("")) for p in parts]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*inner)), ","), F.lit("}"))


def citation_json(c: Column) -> Column:
    """Law citations always show their four main fields, null or not; all other fields only if they are set."""
    common = F.to_json(F.struct(*[c[n].alias(n) for n in _COMMON]))
    law = _objects(common, F.to_json(F.struct(*[c[n].alias(n) for n in _LAW_ALWAYS]), {"ignoreNullFields": "false"}), F.to_json(F.struct(*[_set_only(c, n) for n in _LAW_IF_SET])))
    case = _objects(common, F.to_json(F.struct(*[_set_only(c, n) for n in _CASE_IF_SET])))
    return F.when(c["type"] == "law", law).when(c["type"] == "case", case).otherwise(common)


def relation_json(r: Column) -> Column:
    return F.to_json(r)


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def jsonl(df: DataFrame) -> DataFrame:
    """``(doc_id, value)``: a line of JSON for each document with ``citations`` and ``relations``; write ``value`` as text."""
    head = F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id")))
    body = F.concat(F.lit('{"citations":'), _list(F.transform("citations", citation_json)), F.lit(',"relations":'), _list(F.transform("relations", relation_json)), F.lit("}"))
    return df.select("doc_id", _objects(head, body).alias("value"))


def pretty_json(df: DataFrame) -> DataFrame:
    """``(doc_id, value)``: the same, indented."""
    schema = f"struct<doc_id:string,citations:array<{CITATION}>,relations:array<{RELATION}>>"
    return jsonl(df).select("doc_id", F.to_json(F.from_json("value", schema), {"pretty": "true"}).alias("value"))


def label(c: Column) -> Column:
    return F.concat(F.upper(c["type"]), F.lit("_REF"))


def spacy(df: DataFrame) -> DataFrame:
    """``(doc_id, text, tokens, spans)`` with spans over tokens; citations whose first or last character is in no token are left out."""
    tok = F.col("__t")

    def index(at: Column) -> Column:
        return F.array_position(F.transform(tok, lambda t: (t["start"] <= at) & (at < t["end"])), True).cast("int") - 1

    def one(c: Column) -> Column:
        last = F.greatest(c["span"]["start"], c["span"]["end"] - 1)
        return F.struct(index(c["span"]["start"]).alias("start_token"), (index(last) + 1).alias("end_token"), label(c).alias("label"), c["id"].alias("kb_id"))

    cur = fixed(fixed(df, "__t", tokens(F.col("text"))), "spans", F.filter(F.transform("citations", one), lambda s: (s["start_token"] >= 0) & (s["end_token"] > 0)))
    return cur.select("doc_id", "text", F.transform("__t", lambda t: F.struct(t["text"].alias("orth"), t["space"].alias("space"))).alias("tokens"), "spans")


def gliner(df: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` of ``struct<start,end,label,text>``."""
    return df.select("doc_id", F.transform("citations", lambda c: F.struct(c["span"]["start"].alias("start"), c["span"]["end"].alias("end"), label(c).alias("label"), c["span"]["text"].alias("text"))).alias("spans"))


def web_annotations(df: DataFrame, source: Column | str = "", namespace: str = "urn:citation:") -> DataFrame:
    """``(doc_id, annotation)``: a W3C annotation in JSON for each citation."""
    uri = F.lit(source) if isinstance(source, str) else source
    rows = df.select("doc_id", uri.cast("string").alias("uri"), F.explode("citations").alias("c"))
    c = F.col("c")
    body = _objects(F.to_json(F.struct(F.lit("TextualBody").alias("type"), F.lit("tagging").alias("purpose"), label(c).alias("value"))), F.concat(F.lit('{"properties":'), citation_json(c), F.lit("}")))
    head = F.to_json(F.struct(F.lit(W3C).alias("@context"), F.concat(F.lit(namespace), c["id"]).alias("id"), F.lit("Annotation").alias("type"), F.lit("classifying").alias("motivation")))
    place = F.struct(F.lit("TextPositionSelector").alias("type"), c["span"]["start"].alias("start"), c["span"]["end"].alias("end"))
    target = F.to_json(F.struct(F.struct(F.col("uri").alias("source"), place.alias("selector")).alias("target")))
    return rows.select("doc_id", _objects(head, F.concat(F.lit('{"body":'), body, F.lit("}")), target).alias("annotation"))


def _escape(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def akn_href(c: Column) -> Column:
    part = lambda n: F.coalesce(c[n], F.lit(""))
    law = F.concat(F.lit("/akn/de/act/"), part("book"), F.lit("/~"), part("number"))
    case = F.concat(F.lit("/akn/de/judgment/"), part("court"), F.lit("/"), part("file_number"))
    return F.when(c["type"] == "law", law).when(c["type"] == "case", case).otherwise("")


def akn(df: DataFrame) -> DataFrame:
    """``(doc_id, akn)``: the text with each (disjoint) citation in a ``<ref>``; only what is within is escaped."""
    text = F.col("text")
    ordered = F.array_sort(F.transform("citations", lambda c, i: F.struct(c["span"]["start"].alias("s"), i.alias("i"), c["span"]["end"].alias("e"), c["id"].alias("id"), akn_href(c).alias("href"))))

    def step(acc: Column, x: Column) -> Column:
        ref = F.concat(F.lit('<ref eId="'), _escape(x["id"]), F.lit('" href="'), _escape(x["href"]), F.lit('">'), _escape(slice_text(text, x["s"], x["e"])), F.lit("</ref>"))
        return F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(slice_text(text, acc["at"], x["s"]), ref)).alias("out"))

    cur = fixed(df, "__a", F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step))
    return cur.select("doc_id", F.concat(F.array_join("__a.out", ""), F.substr(text, F.col("__a.at") + 1)).alias("akn"))


def to_markers(citations: Column) -> Column:
    """Citations as markers of one reference each, for users of the older interface; null fields become empty."""
    e = lambda x: F.coalesce(x, F.lit(""))

    def one(c: Column) -> Column:
        law = c["type"] == "law"
        ref = F.struct(F.when(law, e(c["book"])).alias("book"), F.when(law, e(c["number"])).alias("section"), F.when(~law, e(c["court"])).alias("court"), F.when(~law, e(c["file_number"])).alias("file_number"))
        return F.struct(F.lit(0).alias("phase"), c["span"]["start"].alias("start"), c["span"]["end"].alias("end"), c["span"]["text"].alias("text"), F.array(ref).alias("refs"))

    return F.transform(citations, one).cast(f"array<{MARKER}>")
