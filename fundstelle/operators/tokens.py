"""White-space tokens, BIO labels both ways, and features for sequence models."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundstelle.functions.dialect import FLAGS, fixed, guarded, let, matches
from fundstelle.schema import CITATION, citation, citation_id, span
from fundstelle.sources.lexicon import register_code_set

TOKEN = "struct<start:int,end:int,text:string,space:boolean>"
LABELS = ("O", *(f"{p}-{kind}_REF" for kind in ("LAW", "CASE") for p in "BI"))
#: Label names of other models.
ALIASES = {f"{p}-{a}": f"{p}-{b}_REF" for p in "BI" for a, b in (("LAW", "LAW"), ("GS", "LAW"), ("VO", "LAW"), ("RS", "CASE"), ("AZ", "CASE"), ("CASE", "CASE"), ("LAW_REF", "LAW"), ("CASE_REF", "CASE"))} | {"O": "O"}


def tokens(text: Column) -> Column:
    """``array<TOKEN>`` of what white space parts; ``space`` tells if a blank or tab follows."""
    found = matches(guarded(text), r"\S+")
    return F.when(text.isNotNull(), F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.substring(m["gap"], 1, 1).isin(" ", "\t").alias("space")))).otherwise(F.array().cast(f"array<{TOKEN}>"))


def bio_labels(token: Column, citations: Column) -> Column:
    """A label for each token: ``B-`` for the first that a citation touches, ``I-`` for its others; later citations win.

    Tokens are in order and disjoint, so a citation touches neighbours only, and a look at the token before tells if one is the first.
    """

    def label(toks: Column, cites: Column, t: Column, i: Column) -> Column:
        touching = F.filter(cites, lambda c: (t["start"] < c["span"]["end"]) & (t["end"] > c["span"]["start"]))

        def named(hit: Column) -> Column:
            inner = (i > 0) & (F.get(toks, i - 1)["end"] > hit["span"]["start"])
            return F.when(hit.isNull(), "O").otherwise(F.concat(F.when(inner, "I-").otherwise("B-"), F.upper(hit["type"]), F.lit("_REF")))

        return let(F.try_element_at(touching, F.lit(-1)), named)

    # a column may be an expression, which a lambda would compute anew for each token
    return let(token, lambda toks: let(citations, lambda cites: F.transform(toks, lambda t, i: label(toks, cites, t, i))))


def map_labels(labels: Column, aliases: dict[str, str] | None = None) -> Column:
    """Labels in this library's names; unknown ones are ``O``."""
    table = F.create_map(*[F.lit(x) for kv in (aliases or ALIASES).items() for x in kv])
    return F.transform(labels, lambda x: F.coalesce(F.try_element_at(table, x), F.lit("O")))


def bio_spans(token: Column, labels: Column) -> Column:
    """``array<struct<label,start,end>>``: ``B-`` opens a span, any ``I-`` goes on whatever its type, ``O`` closes; an ``I-`` without a span is ignored."""
    kind = "array<struct<label:string,start:int,end:int>>"

    def step(acc: Column, x: Column) -> Column:
        t, lab = x["0"], x["1"]
        begin = F.array(F.struct(F.substr(lab, F.lit(3)).alias("label"), t["s"].alias("start"), t["e"].alias("end")))
        last = F.element_at(acc["out"], -1)
        longer = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.struct(last["label"].alias("label"), last["start"].alias("start"), t["e"].alias("end"))))
        opens, goes = lab.startswith("B-"), lab.startswith("I-") & x["goes"] & acc["open"]
        return F.struct(F.when(opens, F.concat(acc["out"], begin)).when(goes, longer).otherwise(acc["out"]).alias("out"), (opens | goes).alias("open"))

    inside = lambda lab: lab.startswith("B-") | lab.startswith("I-")

    def marked(labs: Column) -> Column:
        zipped = F.zip_with(token, labs, lambda t, lab: F.struct(F.struct(t["start"].alias("s"), t["end"].alias("e")).alias("0"), F.coalesce(lab, F.lit("O")).alias("1")))
        placed = F.transform(zipped, lambda z, i: F.struct(z["0"].alias("0"), z["1"].alias("1"), F.coalesce(inside(F.get(labs, i - 1)), F.lit(False)).alias("goes")))
        return F.filter(placed, lambda z: z["0"]["s"].isNotNull() & inside(z["1"]))

    # the fold copies what it has at every step: it goes over the labels of spans alone, of which ``goes`` tells if one stands right behind another
    return F.aggregate(let(labels, marked), F.struct(F.array().cast(kind).alias("out"), F.lit(False).alias("open")), step)["out"]


def parse_law(text: Column) -> Column:
    """``struct<book,number>`` of a law span: the number behind the section sign, and the last word if it is a name."""
    number = F.nullif(F.trim(F.regexp_extract(text, FLAGS + r"^§{1,2}\s*(\d+(?:\s?[a-z])?)", 1)), F.lit(""))
    last = F.element_at(F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+"), -1)
    book = F.when(last.rlike("^[A-ZÄÖÜ]") & ~last.isin("Abs.", "Nr.", "S."), F.lower(last))
    return F.struct(book.alias("book"), number.alias("number"))


def parse_case(text: Column) -> Column:
    """``struct<court,file_number>`` of a case span."""
    number = F.nullif(F.regexp_extract(text, FLAGS + r"(?:\d+|[VIX]+)\s+[A-Z][a-zA-Z]{0,4}\s+\d+[./]\d{2,4}", 0), F.lit(""))
    court = F.nullif(F.trim(F.regexp_extract(text, FLAGS + r"^([ÄÖÜA-Z][-\säöüßÄÖÜa-zA-Z]+?)(?=,|\s+(?:vom|\d|Beschl|Urteil))", 1)), F.lit(""))
    return F.struct(court.alias("court"), number.alias("file_number"))


def model_citations(spans: Column, text: Column, confidence: float) -> Column:
    """``array<CITATION>`` of decoded spans; labels other than LAW_REF and CASE_REF are left out."""

    def one(s: Column) -> Column:
        body = F.substr(text, s["start"] + 1, s["end"] - s["start"])
        sp = span(s["start"], s["end"], body)
        law, case = parse_law(body), parse_case(body)
        is_law = s["label"] == "LAW_REF"
        article = body.startswith("Art") | body.startswith("art")
        return citation(
            id=citation_id(sp), type=F.when(is_law, "law").otherwise("case"), span=sp, confidence=F.lit(confidence),
            unit=F.when(is_law, F.when(article, "article").otherwise("paragraph")), delimiter=F.when(is_law, F.when(article, "Art.").otherwise("§")),
            book=F.when(is_law, law["book"]), number=F.when(is_law, law["number"]), court=F.when(~is_law, case["court"]), file_number=F.when(~is_law, case["file_number"]),
        )

    return F.transform(F.filter(spans, lambda s: s["label"].isin("LAW_REF", "CASE_REF")), one).cast(f"array<{CITATION}>")


def tagger_engine(load, confidence: float = 0.8):
    """An engine from a model: ``load()`` gives, once for each task, a function from lists of tokens to lists of labels.

    Windows over long inputs (512 tokens every 384, where the earlier one's labels win) are ``windowed``'s task.
    """

    def run(df: DataFrame, text: str, out: str) -> DataFrame:
        @F.pandas_udf("array<string>")  # type: ignore[call-overload]
        def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for s in batches:
                yield pd.Series([list(x) for x in model([list(t) for t in s])])

        cur = fixed(df, "__tok", tokens(F.col(text)))
        cur = cur.withColumn("__lab", tag(F.transform("__tok", lambda t: t["text"])))
        spans = bio_spans(F.col("__tok"), map_labels(F.col("__lab")))
        return fixed(cur, "__sp", spans).withColumn(out, model_citations(F.col("__sp"), F.col(text), confidence)).drop("__tok", "__lab", "__sp")

    return run


def windowed(label, size: int = 512, stride: int = 128):
    """Label long token lists window by window; where windows overlap by ``stride`` tokens the earlier one wins."""

    def run(batch: list[list[str]]) -> list[list[str]]:
        out = []
        for toks in batch:
            got: list[str] = []
            at = 0
            while len(got) < len(toks):
                part = label([toks[at : at + size]])[0]
                got += part[len(got) - at :]
                at += size - stride
            out.append(got)
        return out

    return run


def word_shape(w: Column) -> Column:
    """``d`` up to four times, XX, xx, Xx or other."""
    digits = w.rlike(r"(?U)^\d+$")
    letters = w.rlike(r"(?U)\p{L}")
    upper, lower = letters & (F.upper(w) == w), letters & (F.lower(w) == w)
    plain = w.rlike(r"(?U)^\p{L}+$")
    title = plain & w.rlike(r"(?U)^\p{Lu}")
    return F.when(digits, F.repeat(F.lit("d"), F.least(F.length(w), F.lit(4)))).when(plain & upper, "XX").when(plain & lower, "xx").when(title, "Xx").otherwise("other")


def token_features(df: DataFrame) -> DataFrame:
    """Features of tokens ``(doc_id, pos, word)`` and of their neighbours, for training a tagger."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    low, word = F.lower("word"), F.col("word")
    sign = word.isin("§", "§§")
    letters = word.rlike(r"(?U)\p{L}")
    title = letters & (F.initcap(word) == word) & word.rlike(r"(?U)^\P{L}*\p{Lu}")
    own = {
        "lower": low, "shape": word_shape(word), "len": F.least(F.length(word), F.lit(10)).cast("string"), "isdigit": word.rlike(r"(?U)^\d+$"), "isupper": letters & (F.upper(word) == word), "istitle": title,
        "has_slash": word.contains("/"), "has_dot": word.contains("."), "has_hyphen": word.contains("-"), "prefix2": F.left(low, F.lit(2)), "suffix2": F.right(low, F.lit(2)), "suffix3": F.right(low, F.lit(3)),
        "is_section": sign, "is_art": low.startswith("art"), "is_abs": low.isin("abs.", "abs"), "is_nr": low.isin("nr.", "nr"), "is_satz": low.isin("satz", "s."), "is_ivm": low.isin("ivm", "i.v.m."),
        "is_register": word.isin(*sorted(register_code_set())), "looks_like_year": word.rlike(r"^\d{2,4}$"), "looks_like_fn": word.rlike(r"^\d+/\d{2}$"),
    }
    cur = df.select("doc_id", "pos", "word", *[v.alias(k) for k, v in own.items()])
    near = {f"{side}_{c}": fn(c).over(w) for side, fn in (("prev", F.lag), ("next", F.lead)) for c in ("lower", "is_section", "isdigit", "isupper", "shape")}
    near |= {"prev2_lower": F.lag("lower", 2).over(w), "next2_lower": F.lead("lower", 2).over(w)}
    cur = cur.select("*", *[v.alias(k) for k, v in near.items()])
    return cur.withColumn("bos", F.col("prev_lower").isNull()).withColumn("eos", F.col("next_lower").isNull())


def feature_strings(df: DataFrame) -> DataFrame:
    """``(doc_id, pos, features)``: a true flag as its name, a false or null one left out, others as ``name=value``."""
    parts = []
    for name, kind in df.dtypes:
        if name not in ("doc_id", "pos", "word"):
            parts.append(F.when(F.col(name), name) if kind == "boolean" else F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}="), F.col(name).cast("string"))))
    return df.select("doc_id", "pos", F.array_compact(F.array(F.lit("bias"), *parts)).alias("features"))


def bio_records(docs: DataFrame) -> DataFrame:
    """``(doc_id, tokens, ner_tags)`` of documents with ``text`` and gold ``citations``, of which only law and case count."""
    gold = F.filter("citations", lambda c: c["type"].isin("law", "case"))
    cur = fixed(docs, "__t", tokens(F.col("text"))).withColumn("__g", gold)
    return cur.select("doc_id", F.transform("__t", lambda t: t["text"]).alias("tokens"), bio_labels(F.col("__t"), F.col("__g")).alias("ner_tags"))


def bio_statistics(records: DataFrame) -> DataFrame:
    tags = F.col("ner_tags")
    return records.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.size(F.filter(tags, lambda t: t.startswith("B-")))), F.lit(0)).cast("long").alias("citations"), F.coalesce(F.sum(F.size(F.filter(tags, lambda t: t != "O"))), F.lit(0)).cast("long").alias("tagged_tokens"))
