"""Registered queries over the derived corpus and the relational tables, with SQL for their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundstelle.functions.dialect import fixed, mask_intervals, matches
from fundstelle.operators import adapt, diagnose, export, merge, normalize, resolve, score, tokens, validate
from fundstelle.operators.case import case_citations, with_case_markers
from fundstelle.operators.law import law_citations, with_context_markers, with_law_markers
from fundstelle.plans.corpus import CASE, LAW, MIXED, RELATED, Template, lit
from fundstelle.plans.pipeline import citation_rows, extract, extract_markers, relation_rows
from fundstelle.schema import CITATION, citation, citation_id, span
from fundstelle.sources import lexicon

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def _exploded(df: DataFrame, citations, *fields: str) -> DataFrame:
    rows = fixed(df, "__c", citations).select("doc_id", F.explode_outer("__c").alias("c")).where("c is not null")
    return rows.select("doc_id", F.col("c.span.start").cast("long").alias("start_pos"), F.col("c.span.end").cast("long").alias("end_pos"), F.col("c.span.text").alias("span_text"), *[F.col(f"c.{f}").alias(f) for f in fields])


def _refs(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.explode_outer("markers").alias("m")).select("doc_id", F.explode_outer("m.refs").alias("r")).where("r is not null").select("doc_id", "r.book", F.col("r.section").alias("number"))


# -- law and case engines
def _law(t: Template) -> Query:
    return lambda spark, d: _exploded(with_law_markers(t.docs(spark, d)), law_citations(F.col("markers")), "book", "number", "unit")


def _case(t: Template) -> Query:
    return lambda spark, d: _exploded(with_case_markers(t.docs(spark, d)), case_citations(F.col("markers")), "court", "file_number")


for _name, _t in LAW.items():
    add(_name, _law(_t), _t.expected("book", "number", "unit"))
for _name, _t in CASE.items():
    add(_name, _case(_t), _t.expected("court", "file_number"))

_RANGE = Template(["Nach ", "§§ {n} bis {n3} BauNVO", ", die"])
add(
    "law_range_expand",
    lambda spark, d: _refs(with_law_markers(_RANGE.docs(spark, d))),
    " union all ".join(f"select doc_id, 'baunvo' as book, {Template.sql(x)} as number from documents" for x in ("{n}", "{n1}", "{n2}", "{n3}")),
)
_ARTICLES = Template(["Die ", "Art. {n}, {n1}, {n2} GG", " schützen"])
add(
    "law_article_multi",
    lambda spark, d: _refs(with_law_markers(_ARTICLES.docs(spark, d))),
    " union all ".join(f"select doc_id, 'gg' as book, {Template.sql(x)} as number from documents" for x in ("{n}", "{n1}", "{n2}")),
)
_GENERIC = Template(["Nach ", "§ {n} XyzG", " und § {m} SGB X gilt"])
add(
    "law_generic_mode",
    lambda spark, d: _refs(with_law_markers(_GENERIC.docs(spark, d), lexicon=lexicon.load_law_lexicon(precise=False))),
    f"select doc_id, 'xyzg' as book, {Template.sql('{n}')} as number from documents union all select doc_id, 'sgb x', {Template.sql('{m}')} from documents",
)
_CONTEXT = Template(["Die ", "§§ {n} bis {n2}", " und Anlage {a} sowie § {m} Absatz 2 Satz 1"])
add(
    "law_context_mode",
    lambda spark, d: _refs(with_context_markers(_CONTEXT.docs(spark, d), "zpo")),
    " union all ".join(f"select doc_id, 'zpo' as book, {Template.sql(x)} as number from documents" for x in ("{n}", "{n1}", "{n2}", "anlage-{a}", "{m}")),
)
_ENTITY = Template(["Die ", "&#167; {n} BGB", " und &#167;&#167; {m}, {m1} ZPO, so"])
add(
    "law_html_entities",
    lambda spark, d: _refs(with_law_markers(_ENTITY.docs(spark, d), html=True)),
    " union all ".join(f"select doc_id, {lit(b)} as book, {Template.sql(x)} as number from documents" for b, x in (("bgb", "{n}"), ("zpo", "{m}"), ("zpo", "{m1}"))),
)
add(
    "law_code_units",
    lambda spark, d: _exploded(with_law_markers(LAW["law_unit_hint"].docs(spark, d)), law_citations(F.col("markers")), "book").join(F.broadcast(lexicon.law_codes(spark).select(F.lower("code").alias("book"), "unit")), "book", "left").groupBy("book", "unit").agg(F.count(F.lit(1)).alias("n")),
    "select 'gg' as book, 'article' as unit, count(*) as n from documents having count(*) > 0 union all select 'bgb', 'paragraph', count(*) from documents having count(*) > 0",
)
add(
    "law_collapsed_multi",
    lambda spark, d: _exploded(extract(LAW["law_multi_sections"].docs(spark, d), normalize=False, multi_ref="collapse"), F.col("citations"), "book", "number"),
    Template(["Laut ", "§§ {n}, {m} BGB", " gilt"], [LAW["law_multi_sections"].cites[0]]).expected("book", "number"),
)
add(
    "mask_intervals",
    lambda spark, d: fixed(LAW["law_single"].docs(spark, d), "m", matches(F.col("text"), "§ [0-9]+ BGB")).select("doc_id", mask_intervals(F.col("text"), F.col("m")).alias("masked")),
    f"select doc_id, concat(coalesce(text, ''), ' Nach ', repeat('_', length({LAW['law_single'].parts[1]})), ' gilt dies.') as masked from documents",
)

# -- merge, short forms, relations
_mixed: Query = lambda spark, d: extract(MIXED.docs(spark, d), normalize=False)
add("pipeline_end_to_end", lambda spark, d: _exploded(_mixed(spark, d), F.col("citations"), "type", "book", "number", "court", "file_number"), MIXED.expected("type", "book", "number", "court", "file_number"))


def _relations_sql(t: Template, pairs: list[tuple[int, int, int, str]]) -> str:
    ident = lambda i: f"substr(sha256(concat_ws('|', '', cast({t.start(t.cites[i])} as string), cast({t.start(t.cites[i])} + length({t.span(t.cites[i])}) as string), {t.span(t.cites[i])}, 'regex')), 1, 12)"
    rows = []
    for a, b, part, name in pairs:
        start = f"length({t.joined(t.lead + t.parts[:part])})"
        rows.append(f"select doc_id, {ident(a)} as source_id, {ident(b)} as target_id, {lit(name)} as relation, cast({start} as bigint) as start_pos, {t.parts[part]} as span_text from documents")
    return " union all ".join(rows)


add(
    "relations_adjacent",
    lambda spark, d: relation_rows(extract(RELATED.docs(spark, d), normalize=False)).select("doc_id", "source_id", "target_id", "relation", F.col("span.start").cast("long").alias("start_pos"), F.col("span.text").alias("span_text")),
    _relations_sql(RELATED, [(0, 1, 3, "ivm"), (1, 2, 7, "vgl")]),
)


def _overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    one = lambda a, b, c: citation(id=F.lit("x"), type=F.lit("law"), span=span(a, b, F.lit("")), confidence=F.lit(c))
    n = (F.col("doc_id") % 5).cast("int")
    # the second beats the first; the third overlaps and is no surer; the fourth stands alone
    four = F.array(one(F.lit(0), F.lit(10), 0.5), one(F.lit(5), n + 15, 0.9), one(n + 12, n + 20, 0.9), one(n + 20, n + 30, 0.1)).cast(f"array<{CITATION}>")
    return _exploded(fixed(docs, "all", four), merge.resolve_overlaps(F.col("all")), "confidence")


add(
    "overlap_merge",
    _overlap,
    "select doc_id, cast(5 as bigint) as start_pos, doc_id % 5 + 15 as end_pos, '' as span_text, cast(0.9 as double) as confidence from documents union all select doc_id, doc_id % 5 + 20, doc_id % 5 + 30, '', cast(0.1 as double) from documents",
)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Line numbers repeat within an order; these don't.
_N = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag)"
_LINES = f"(select l_orderkey, l_partkey, l_suppkey, l_quantity, l_returnflag, cast({_N} as int) as l_n from lineitem) t"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", f"cast({_N} as int) as l_n")


_LAW_ROWS = ["l_orderkey as doc_id", "l_n as ord", "'law' as type", "concat('i', cast(l_n as string)) as id", "case when l_suppkey % 3 = 0 then concat('b', cast(l_suppkey % 7 as string)) end as book", "'full' as kind", "cast(null as string) as resolves_to"]
add(
    "short_form_asof",
    lambda spark, d: resolve.resolve_law_rows(_lines(spark, d).selectExpr(*_LAW_ROWS)).select(F.col("doc_id"), F.col("ord").cast("long").alias("ord"), "id", "book", "kind", "resolves_to"),
    f"with r as (select {', '.join(_LAW_ROWS)} from {_LINES}), w as (select *, last_value(case when book is not null then book end ignore nulls) over v as lb, last_value(case when book is not null then id end ignore nulls) over v as li from r window v as (partition by doc_id order by ord rows between unbounded preceding and 1 preceding)) "
    "select doc_id, cast(ord as bigint) as ord, id, coalesce(book, lb) as book, case when book is null and lb is not null then 'short' else 'full' end as kind, case when book is null then li end as resolves_to from w",
)
_CASE_ROWS = ["l_orderkey as doc_id", "l_n as ord", "'case' as type", "case when l_suppkey % 2 = 0 then case when l_partkey % 2 = 0 then 'BGH' else 'BVerwG' end end as court", "'1 A 2/03' as file_number", "case when l_suppkey % 2 = 1 then 'BGHZ' end as reporter", "'full' as kind"]
add(
    "case_short_form",
    lambda spark, d: resolve.resolve_case_rows(_lines(spark, d).selectExpr(*_CASE_ROWS)).select("doc_id", F.col("ord").cast("long").alias("ord"), "court", "kind"),
    f"with r as (select {', '.join(_CASE_ROWS)} from {_LINES}), w as (select *, last_value(case when reporter is null then court end ignore nulls) over v as lc from r window v as (partition by doc_id order by ord rows between unbounded preceding and 1 preceding)) "
    "select doc_id, cast(ord as bigint) as ord, case when court is null and lc = 'BGH' then 'BGH' else court end as court, case when court is null and lc = 'BGH' then 'short' else 'full' end as kind from w",
)


def _ensemble(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).selectExpr("l_orderkey as doc_id", "l_n as ord", "l_n * 20 + cast(l_quantity as int) % 9 as s", "l_returnflag as f", "l_suppkey as k")
    make = lambda df, src, shift: df.select("doc_id", F.struct((F.col("s") + shift).alias("start"), (F.col("s") + shift + 8).alias("end")).alias("span"), F.lit(src).alias("source"))
    out = merge.ensemble(make(rows.where("f <> 'N'"), "rules", 0), make(rows, "model", (F.col("k") % 15).cast("int")))
    return out.select("doc_id", F.col("span.start").cast("long").alias("start_pos"), "source")


add(
    "engine_antijoin_merge",
    _ensemble,
    f"with r as (select l_orderkey as doc_id, l_n * 20 + cast(l_quantity as int) % 9 as s, l_returnflag as f, l_suppkey % 15 as k from {_LINES}), a as (select doc_id, s, s + 8 as e from r where f <> 'N'), b as (select doc_id, s + k as s, s + k + 8 as e from r) "
    "select doc_id, cast(s as bigint) as start_pos, 'rules' as source from a union all select doc_id, cast(s as bigint), 'model' from b where not exists (select 1 from a where a.doc_id = b.doc_id and b.s < a.e and a.s < b.e)",
)
add(
    "citation_ids",
    lambda spark, d: _table(spark, d, "documents").select("doc_id", citation_id(span(F.lit(3), (F.col("doc_id") % 50).cast("int") + 4, F.concat(F.lit("§ "), F.col("doc_id"))), "regex", F.col("doc_id")).alias("id")),
    "select doc_id, substr(sha256(concat_ws('|', cast(doc_id as varchar), '3', cast(doc_id % 50 + 4 as varchar), concat('§ ', cast(doc_id as varchar)), 'regex')), 1, 12) as id from documents",
)

# -- normalisation
_FORMATS = "case doc_id % 5 when 0 then '<p>x</p>' when 1 then concat('# T', chr(10), 'x') when 2 then 'ein **fettes** Wort' when 3 then '  <div>y</div>' else 'nur Text' end"
add(
    "detect_format",
    lambda spark, d: _table(spark, d, "documents").selectExpr("doc_id", f"{_FORMATS} as raw").select("doc_id", normalize.detect_format(F.col("raw")).alias("format")),
    "select doc_id, case doc_id % 5 when 0 then 'html' when 1 then 'markdown' when 2 then 'markdown' when 3 then 'html' else 'plain' end as format from documents",
)
_HTML = Template(["<html><head><title>T</title></head><body><p>Gem&auml;&szlig; &#167; {n} <b>BGB</b> gilt.</p><script>x()</script><p>A  &amp; B</p></body></html>"], noise=False)
add(
    "normalize_html",
    lambda spark, d: normalize.with_normalized(_HTML.docs(spark, d).withColumnRenamed("text", "raw")).select("doc_id", "format", "text"),
    f"select doc_id, 'html' as format, concat({Template.sql('Gemäß § {n} BGB gilt.')}, chr(10), chr(10), 'A & B') as text from documents",
)
_MD = Template(["## Titel {n}\n\nLaut **§ {n} Abs. 1 BGB** und [§ {m} VwGO](https://x.org/{m}) mit `Code`."], noise=False)
add(
    "normalize_markdown",
    lambda spark, d: normalize.with_normalized(_MD.docs(spark, d).withColumnRenamed("text", "raw")).select("doc_id", "format", "text"),
    f"select doc_id, 'markdown' as format, {Template.sql('Titel {n}' + chr(10) + chr(10) + 'Laut § {n} Abs. 1 BGB und § {m} VwGO mit Code.')} as text from documents",
)
_RAW = Template(["<p>A &amp; ", "§ {n} BGB", " gilt</p>"], noise=False)


def _raw_spans(spark: SparkSession, d: str) -> DataFrame:
    x = extract(_RAW.docs(spark, d).withColumnRenamed("text", "raw"))
    return x.select("doc_id", "raw", "omap", F.explode_outer("citations").alias("c")).where("c is not null").select("doc_id", normalize.map_span_to_raw(F.col("c.span"), F.col("omap"), F.col("raw")).alias("s")).select("doc_id", F.col("s.start").cast("long").alias("start_pos"), F.col("s.end").cast("long").alias("end_pos"), F.col("s.text").alias("span_text"))


add("map_span_to_raw", _raw_spans, f"select doc_id, cast(length({_RAW.parts[0]}) as bigint) as start_pos, cast(length({_RAW.parts[0]}) + length({_RAW.parts[1]}) as bigint) as end_pos, {_RAW.parts[1]} as span_text from documents")
add(
    "remove_markers",
    lambda spark, d: _table(spark, d, "documents").select("doc_id", normalize.remove_markers(F.concat(F.lit("a [ref=x-1]"), F.col("source"), F.lit("[/ref] b"))).alias("text")),
    "select doc_id, concat('a ', source, ' b') as text from documents",
)
add(
    "mask_for_tokenizer",
    lambda spark, d: normalize.with_tokenizer_mask(Template(["am 1.2.20{y} (x {n}) vgl. so"], noise=False).docs(spark, d)).select("doc_id", "masked"),
    f"select doc_id, concat('am ', repeat('_', 8), ' ', repeat('_', length({Template.sql('(x {n})')})), ' ', repeat('_', 4), ' so') as masked from documents",
)

# -- tokens and exports
add(
    "tokens_whitespace",
    lambda spark, d: _table(spark, d, "documents").select("doc_id", F.posexplode_outer(tokens.tokens(F.col("text"))).alias("pos", "t")).where("t is not null").select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("t.text").alias("word")),
    "with w as (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as ws from documents where text is not null) select doc_id, unnest(ws) as word, cast(unnest(range(len(ws))) as bigint) as pos from w",
)
add(
    "bio_encode",
    lambda spark, d: tokens.bio_records(_law_docs(spark, d)).select("doc_id", F.posexplode_outer(F.arrays_zip("tokens", "ner_tags")).alias("pos", "x")).where("x.ner_tags <> 'O'").select("doc_id", F.col("x.tokens").alias("word"), F.col("x.ner_tags").alias("tag")),
    f"select doc_id, '§' as word, 'B-LAW_REF' as tag from documents union all select doc_id, {Template.sql('{n}')}, 'I-LAW_REF' from documents union all select doc_id, 'BGB', 'I-LAW_REF' from documents",
)


def _law_docs(spark: SparkSession, d: str) -> DataFrame:
    return extract(LAW["law_single"].docs(spark, d), normalize=False)


def _bio_round_trip(spark: SparkSession, d: str) -> DataFrame:
    x = fixed(_law_docs(spark, d), "tok", tokens.tokens(F.col("text")))
    x = fixed(x, "lab", tokens.bio_labels(F.col("tok"), F.col("citations")))
    return _exploded(x, tokens.model_citations(tokens.bio_spans(F.col("tok"), tokens.map_labels(F.col("lab"))), F.col("text"), 0.8), "book", "number", "unit", "confidence")


add("bio_decode", _bio_round_trip, f"select *, cast(0.8 as double) as confidence from ({LAW['law_single'].expected('book', 'number', 'unit')})")
add(
    "token_features",
    lambda spark, d: tokens.token_features(_table(spark, d, "documents").select("doc_id", F.posexplode(F.split("source", "")).alias("pos", "word"))).select("doc_id", F.col("pos").cast("long").alias("pos"), "lower", "isdigit", "prev_lower", "next2_lower", "bos", "eos"),
    "with c as (select doc_id, string_split(source, '') as w from documents where source is not null), t as (select doc_id, unnest(w) as word, cast(unnest(range(len(w))) as bigint) as pos from c) "
    "select doc_id, pos, lower(word) as lower, regexp_matches(word, '^[0-9]+$') as isdigit, lower(lag(word) over v) as prev_lower, lower(lead(word, 2) over v) as next2_lower, (lag(word) over v) is null as bos, (lead(word) over v) is null as eos from t window v as (partition by doc_id order by pos)",
)
add(
    "parse_law_fields",
    lambda spark, d: Template(["§§ {n} a Abs. 1 BGB"], noise=False).docs(spark, d).select("doc_id", tokens.parse_law(F.col("text")).alias("p")).select("doc_id", "p.book", "p.number"),
    f"select doc_id, 'bgb' as book, {Template.sql('{n} a')} as number from documents",
)
add(
    "parse_case_fields",
    lambda spark, d: Template(["BGH, Urteil vom 12.03.2020 - VIII ZR {n}/{y}"], noise=False).docs(spark, d).select("doc_id", tokens.parse_case(F.col("text")).alias("p")).select("doc_id", "p.court", "p.file_number"),
    f"select doc_id, 'BGH' as court, {Template.sql('VIII ZR {n}/{y}')} as file_number from documents",
)
_T, _C = LAW["law_single"], LAW["law_single"].cites[0]
_ID = f"substr(sha256(concat_ws('|', '', cast({_T.start(_C)} as string), cast({_T.start(_C)} + length({_T.span(_C)}) as string), {_T.span(_C)}, 'regex')), 1, 12)"
_END = f"cast({_T.start(_C)} + length({_T.span(_C)}) as string)"
add(
    "export_jsonl",
    lambda spark, d: export.jsonl(_law_docs(spark, d)),
    "select doc_id, concat('{\"doc_id\":\"', cast(doc_id as string), '\",\"citations\":[{\"id\":\"', " + _ID + ", '\",\"type\":\"law\",\"kind\":\"full\",\"span\":{\"start\":', cast(" + _T.start(_C) + " as string), ',\"end\":', " + _END + ", ',\"text\":\"', " + _T.span(_C)
    + ", '\"},\"confidence\":1.0,\"source\":\"regex\",\"unit\":\"paragraph\",\"delimiter\":\"§\",\"book\":\"bgb\",\"number\":\"', " + Template.sql("{n}") + ", '\"}],\"relations\":[]}') as value from documents",
)
add(
    "export_gliner",
    lambda spark, d: export.gliner(_law_docs(spark, d)).select("doc_id", F.explode_outer("spans").alias("s")).where("s is not null").select("doc_id", F.col("s.start").cast("long").alias("start_pos"), F.col("s.end").cast("long").alias("end_pos"), "s.label", F.col("s.text").alias("span_text")),
    f"select *, 'LAW_REF' as label from ({_T.expected()})",
)
add(
    "export_spacy",
    lambda spark, d: export.spacy(_law_docs(spark, d)).select("doc_id", F.explode_outer("spans").alias("s")).where("s is not null").select("doc_id", (F.col("s.end_token") - F.col("s.start_token")).cast("long").alias("n_tokens"), "s.label", "s.kb_id"),
    f"select doc_id, cast(3 as bigint) as n_tokens, 'LAW_REF' as label, {_ID} as kb_id from documents",
)
add(
    "export_akn",
    lambda spark, d: export.akn(_law_docs(spark, d)),
    f"select doc_id, concat(coalesce(text, ''), ' Nach ', '<ref eId=\"', {_ID}, '\" href=\"/akn/de/act/bgb/~', {Template.sql('{n}')}, '\">', {_T.span(_C)}, '</ref>', ' gilt dies.') as akn from documents",
)
add(
    "export_web_annotation",
    lambda spark, d: export.web_annotations(_law_docs(spark, d), F.col("doc_id")).select("doc_id", F.get_json_object("annotation", "$.id").alias("id"), F.get_json_object("annotation", "$.body.properties.book").alias("book"), F.get_json_object("annotation", "$.target.source").alias("uri"), F.get_json_object("annotation", "$.target.selector.start").cast("long").alias("start_pos")),
    f"select doc_id, concat('urn:citation:', {_ID}) as id, 'bgb' as book, cast(doc_id as string) as uri, cast({_T.start(_C)} as bigint) as start_pos from documents",
)
add(
    "legacy_markers",
    lambda spark, d: _exploded_markers(extract_markers(MIXED.docs(spark, d))),
    " union all ".join(f"select doc_id, cast({MIXED.start(c)} as bigint) as start_pos, {MIXED.span(c)} as span_text from documents" for c in MIXED.cites),
)


def _exploded_markers(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.explode_outer("markers").alias("m")).where("m is not null").select("doc_id", F.col("m.start").cast("long").alias("start_pos"), F.col("m.text").alias("span_text"))


_EXPANDED = Template(["Der ", "BGH, Urteil vom 20.02.2013 - VIII ZR {m}/{y}", " und ", "§§ {n}", ", ", "{m} BGB", ", so"])
add(
    "adapt_citations",
    lambda spark, d: adapt.markers_to_citations(extract_markers(_EXPANDED.docs(spark, d))).select("doc_id", "id", "type", F.col("start").cast("long").alias("start_pos"), F.col("text").alias("span_text"), "book", "number", "court", "file_number"),
    " union all ".join(
        f"select doc_id, {lit(i)} as id, {lit(k)} as type, cast(length({_EXPANDED.joined(_EXPANDED.lead + _EXPANDED.parts[:p])}) as bigint) as start_pos, {_EXPANDED.parts[p]} as span_text, {b} as book, {n} as number, {c} as court, {f} as file_number from documents"
        for i, k, p, b, n, c, f in (
            ("p_001", "law", 3, "'bgb'", Template.sql("{n}"), "cast(null as varchar)", "cast(null as varchar)"),
            ("p_002", "law", 5, "'bgb'", Template.sql("{m}"), "cast(null as varchar)", "cast(null as varchar)"),
            ("p_003", "case", 1, "cast(null as varchar)", "cast(null as varchar)", "'BGH'", Template.sql("VIII ZR {m}/{y}")),
        )
    ),
)

# -- scores, checks and diagnosis
_GOLD = [
    "l_orderkey as doc_id", "l_n as ord", "concat('c', cast(l_n as string)) as id", "case when l_n % 2 = 0 then 'law' else 'case' end as type", "l_n * 20 as start", "l_n * 20 + 10 as \"end\"",
    "concat('b', cast(l_suppkey % 11 as string)) as book", "cast(l_partkey % 500 as string) as number", "concat('LG ', cast(l_suppkey % 5 as string)) as court", "case l_suppkey % 3 when 0 then '1 A 2/03' when 1 then 'C 4.05' else 'AB-7' end as file_number",
]
#: Predictions: every 7th is missing, every 11th ends late, every 13th names another book, every 5th has one more beside it.
_PRED = [x if "as \"end\"" not in x else "l_n * 20 + 10 + case when l_partkey % 11 = 0 then 2 else 0 end as \"end\"" for x in _GOLD]
_PRED = [x if "as book" not in x else "case when l_partkey % 13 = 0 then 'zz' else concat('b', cast(l_suppkey % 11 as string)) end as book" for x in _PRED]
_EXTRA = [x if "as start" not in x else "l_n * 20 + 12 as start" for x in _GOLD]
_EXTRA = [x if "as \"end\"" not in x else "l_n * 20 + 16 as \"end\"" for x in _EXTRA]
_EXTRA = [x if "as ord" not in x else "l_n + 100 as ord" for x in _EXTRA]
_WITH = f"with gold as (select {', '.join(_GOLD)} from {_LINES}), pred as (select {', '.join(_PRED)} from {_LINES} where l_partkey % 7 <> 0 union all select {', '.join(_EXTRA)} from {_LINES} where l_partkey % 5 = 0)"


def _gold_pred(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _lines(spark, d)
    q = lambda xs: [x.replace('"end"', "`end`") for x in xs]
    return rows.selectExpr(*q(_GOLD)), rows.where("l_partkey % 7 <> 0").selectExpr(*q(_PRED)).union(rows.where("l_partkey % 5 = 0").selectExpr(*q(_EXTRA)))


_PRF = "tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) as recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) as f1"
_FULL = 'from gold g full join pred p on g.doc_id = p.doc_id and g.start = p.start and g."end" = p."end"'
_COUNT = 'cast(count(*) filter (g.id is not null and p.id is not null) as bigint) as tp, cast(count(*) filter (g.id is null) as bigint) as fp, cast(count(*) filter (p.id is null) as bigint) as fn'
add("score_span_exact", lambda spark, d: score.span_scores(*_gold_pred(spark, d)), f"{_WITH}, n as (select {_COUNT} {_FULL}) select {_PRF} from n")
add("score_span_by_type", lambda spark, d: score.span_scores_by_type(*_gold_pred(spark, d)), f"{_WITH}, n as (select coalesce(g.type, p.type) as type, {_COUNT} {_FULL} and g.type = p.type group by 1) select type, {_PRF} from n")
# gold spans lie 10 apart and no prediction reaches over more than one, so greedy matching is: does any overlap
add(
    "score_span_overlap",
    lambda spark, d: score.overlap_scores(*_gold_pred(spark, d)),
    f"{_WITH}, n as (select k.type, "
    "cast((select count(*) from gold x where (k.type = 'all' or x.type = k.type) and exists (select 1 from pred y where x.doc_id = y.doc_id and (k.type = 'all' or y.type = k.type) and x.start < y.\"end\" and y.start < x.\"end\")) as bigint) as tp, "
    "cast((select count(*) from gold x where k.type = 'all' or x.type = k.type) as bigint) as g, cast((select count(*) from pred x where k.type = 'all' or x.type = k.type) as bigint) as p from (values ('all'), ('law'), ('case')) k(type)), "
    f"c as (select type, tp, p - tp as fp, g - tp as fn from n) select type, {_PRF} from c",
)
_FIELD = " union all ".join(f"select {lit(f)} as field, case when lower(trim(g.{f})) = lower(trim(p.{f})) then 'correct' else 'incorrect' end as o from m where type = {lit(k)}".replace(f"g.{f}", f"g_{f}").replace(f"p.{f}", f"p_{f}") for k, fs in score.FIELDS.items() for f in fs)
_MATCHED = "m as (select g.type, " + ", ".join(f"g.{f} as g_{f}, p.{f} as p_{f}" for fs in score.FIELDS.values() for f in fs) + f" {_FULL} where g.id is not null and p.id is not null)"
_ACC = "cast(count(*) filter (o = 'correct') as bigint) as correct, cast(count(*) filter (o = 'incorrect') as bigint) as incorrect, cast(0 as bigint) as missing_pred, cast(0 as bigint) as missing_gold, round(count(*) filter (o = 'correct') / count(*), 6) as accuracy"
add("field_accuracy", lambda spark, d: score.field_accuracy(*_gold_pred(spark, d)), f"{_WITH}, {_MATCHED}, f as ({_FIELD}) select field, {_ACC} from f group by field")


def _edges(df: DataFrame, shift: int) -> DataFrame:
    return df.where("ord < 100 and ord > 1").select("doc_id", F.concat(F.lit("c"), (F.col("ord") - 1).cast("string")).alias("source_id"), F.col("id").alias("target_id"), F.when((F.col("doc_id") + shift) % 3 == 0, "vgl").otherwise("ivm").alias("relation"))


def _relation_scores(spark: SparkSession, d: str) -> DataFrame:
    gold, _ = _gold_pred(spark, d)
    return score.relation_scores(gold, _edges(gold, 0), gold, _edges(gold, 1))


add(
    "relation_scores",
    _relation_scores,
    f"{_WITH}, e as (select distinct g.doc_id, g.ord from gold g join gold h on g.doc_id = h.doc_id and h.ord = g.ord - 1), c as (select doc_id % 3 as a, (doc_id + 1) % 3 as b from e), "
    f"n as (select cast(count(*) filter ((a = 0) = (b = 0)) as bigint) as tp, cast(count(*) filter ((a = 0) <> (b = 0)) as bigint) as fp, cast(count(*) filter ((a = 0) <> (b = 0)) as bigint) as fn from c) select {_PRF} from n",
)


def _checked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.rpad(F.lit("ab"), 150, "ab").alias("text"))
    gold, _ = _gold_pred(spark, d)
    cites = gold.select("doc_id", "id", "type", F.when(F.col("doc_id") % 17 == 0, "odd").otherwise("full").alias("kind"), "start", "end", F.when(F.col("doc_id") % 19 == 0, "no").otherwise("ababababab").alias("text"), F.when(F.col("ord") > 1, F.concat(F.lit("c"), (F.col("ord") + F.when(F.col("doc_id") % 23 == 0, 50).otherwise(-1)).cast("string"))).alias("resolves_to"))
    return docs, cites, _edges(gold, 0)


add(
    "validate_corpus",
    lambda spark, d: validate.validate(*_checked(spark, d)).groupBy("check").agg(F.count(F.lit(1)).alias("n")),
    f"{_WITH}, c as (select *, 'c' || cast(ord + case when doc_id % 23 = 0 then 50 else -1 end as varchar) as r from gold), v as ("
    "select 'kind' as check, doc_id from c where doc_id % 17 = 0 union all select 'span', doc_id from c where \"end\" > 150 or doc_id % 19 = 0 union all "
    "select 'resolves_to', doc_id from c where ord > 1 and not exists (select 1 from gold g where g.doc_id = c.doc_id and g.id = c.r) union all "
    "select 'relation_end', doc_id from gold c where ord > 1 and not exists (select 1 from gold g where g.doc_id = c.doc_id and g.ord = c.ord - 1) union all "
    "select 'join', doc_id from (select distinct doc_id from gold) c where not exists (select 1 from orders where o_orderkey = c.doc_id)) select \"check\", count(*) as n from v group by 1",
)
_MISS = "x as (select g.* from gold g where not exists (select 1 from pred p where g.doc_id = p.doc_id and g.start = p.start and g.\"end\" = p.\"end\"))"
add("diagnose_missed_by_type", lambda spark, d: diagnose.by_type(diagnose.missed(*_gold_pred(spark, d))), f"{_WITH}, {_MISS} select type, count(*) as n from x group by type")
add("diagnose_top_books", lambda spark, d: diagnose.top_books(diagnose.missed(*_gold_pred(spark, d))), f"{_WITH}, {_MISS} select book, count(*) as n from x where type = 'law' group by book order by n desc, book limit 20")
add("diagnose_number_shapes", lambda spark, d: diagnose.number_shapes(diagnose.missed(*_gold_pred(spark, d))), f"{_WITH}, {_MISS} select cast(count(*) filter (file_number like '%/%') as bigint) as slash, cast(count(*) filter (file_number like '%.%' and file_number not like '%/%') as bigint) as dot, cast(count(*) filter (file_number = 'AB-7') as bigint) as dash, cast(count(*) filter (file_number = 'AB-7') as bigint) as capitals from x where type = 'case'")
add(
    "diagnose_near_misses",
    lambda spark, d: diagnose.near_misses(*_gold_pred(spark, d)).select("doc_id", "type", *[F.col(c).cast("long").alias(c) for c in ("gold_start", "gold_end", "pred_start", "pred_end")]),
    f"{_WITH}, {_MISS}, y as (select p.* from pred p where not exists (select 1 from gold g where g.doc_id = p.doc_id and g.start = p.start and g.\"end\" = p.\"end\")) "
    "select x.doc_id, x.type, cast(x.start as bigint) as gold_start, cast(x.\"end\" as bigint) as gold_end, cast(y.start as bigint) as pred_start, cast(y.\"end\" as bigint) as pred_end from x join y on x.doc_id = y.doc_id and x.type = y.type and x.start < y.\"end\" and y.start < x.\"end\"",
)
add(
    "document_percentiles",
    lambda spark, d: score.timing_statistics(_table(spark, d, "documents"), "n_chars"),
    "with v as (select list_sort(list(cast(n_chars as double))) as s, count(n_chars) as n, sum(n_chars) as t, avg(n_chars) as a, quantile_cont(n_chars, 0.5) as q from documents) "
    "select n as documents, round(cast(t as double), 6) as total, round(a, 6) as mean, round(q, 6) as median, round(s[least(n - 1, cast(floor(n * 0.95) as bigint)) + 1], 6) as p95, round(s[least(n - 1, cast(floor(n * 0.99) as bigint)) + 1], 6) as p99, round(s[n], 6) as max from v",
)

# -- analytics on the output
add(
    "citations_per_book",
    lambda spark, d: citation_rows(_mixed(spark, d)).where("type = 'law'").groupBy("book").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs")),
    " union all ".join(f"select {lit(b)} as book, count(*) as n, count(distinct doc_id) as docs from documents having count(*) > 0" for b in ("bgb", "zpo", "gg")),
)
_ORDER_TEXT = "concat('Nach § ', cast(o_orderkey % 900 + 1 as string), case o_custkey % 3 when 0 then ' BGB' when 1 then ' ZPO' else ' VwGO' end, ' gilt')"
add(
    "books_by_nation",
    lambda spark, d: _exploded(with_law_markers(_table(spark, d, "orders").selectExpr("o_custkey as doc_id", f"{_ORDER_TEXT} as text")), law_citations(F.col("markers")), "book")
    .join(_table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("k")), "doc_id")
    .groupBy("k", "book")
    .agg(F.count(F.lit(1)).alias("n"))
    .join(F.broadcast(_table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")), "k")
    .select("n_name", "book", "n"),
    "select n_name, case o_custkey % 3 when 0 then 'bgb' when 1 then 'zpo' else 'vwgo' end as book, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2",
)
