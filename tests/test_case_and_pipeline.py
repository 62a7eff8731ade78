import pytest
from pyspark.sql import functions as F

from fundstelle.operators import adapt, diagnose, export, normalize, score, tokens, validate
from fundstelle.operators.case import with_case_markers
from fundstelle.operators.merge import resolve_overlaps
from fundstelle.operators.resolve import resolve_case, resolve_law
from fundstelle.plans.pipeline import case_engine, citation_rows, extract, extract_markers, law_engine, relation_rows
from fundstelle.schema import CITATION, citation, span
from fundstelle.sources import datasets
from fundstelle.sources.lexicon import court_pattern, register_code_set

CASES = [
    ("Das OVG Schleswig habe … Urteil vom 22.04.2010 (1 KN 19/09)", [("OVG Schleswig", "1 KN 19/09")]),
    ("BVerwG 7 A 9.19 - Urteil vom 15. Oktober 2020", [("BVerwG", "7 A 9.19")]),
    ("10 C 23.12", [("", "10 C 23.12")]),
    ("2014/20 und bis 07/20, KW 44/20 sowie 49364 Reifen 245/45 und 12 EUR 100/20", []),
    ("B 6 KA 45/13 R und L 11 KA 67/10 x", [("Bundessozialgericht", "B 6 KA 45/13 R"), ("LSG", "L 11 KA 67/10")]),
    ("LSG Nordrhein-Westfalen, L 11 KA 67/10 x", [("LSG Nordrhein-Westfalen", "L 11 KA 67/10")]),
    ("BGHZ 77, 274 und NZA 2018, 774 x", [("", "BGHZ 77, 274"), ("", "NZA 2018, 774")]),
    ("OLG Frankfurt am Main, 1 U 2/03 x", [("OLG Frankfurt", "1 U 2/03")]),
]


def test_golden_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    got = {r.i: [(m.refs[0].court, m.refs[0].file_number) for m in r.markers] for r in with_case_markers(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    assert {"Ks", "AnwSt", "W", "REMiet"} <= register_code_set() and "(Oder)" not in court_pattern()


TEXTS = {
    "html": "<p>Gem&auml;&szlig; &sect; 433 Abs. 1 BGB schuldet</p><script>evil()</script><p>BGH, Urteil vom 12.03.2020 &ndash; VIII ZR 295/01.</p>",
    "md": "Gemäß **§ 433 Abs. 1 BGB** schuldet [§ 154 VwGO](https://example.com/vwgo/154).",
    "rel": "§ 280 Abs. 1 BGB i.V.m. § 241 Abs. 2 BGB begründen",
    "plain": "Gemäß § 433 BGB und BVerwG 10 C 23.12 ist das klar.",
    "multi": "Foo §§ 556d, 556e BGB bar.",
    "null": None,
    "empty": "",
}


@pytest.fixture(scope="module")
def done(spark):
    docs = datasets.make_documents(spark, list(TEXTS.items()))
    x = extract(docs.select("doc_id", "raw"))
    return spark.createDataFrame(x.collect(), x.schema)


def test_extraction(done):
    rows = {r.doc_id: r for r in done.collect()}
    short = {k: [(c.type, c.book or c.court, c.number or c.file_number) for c in r.citations] for k, r in rows.items()}
    assert short["html"] == [("law", "bgb", "433"), ("case", "BGH", "VIII ZR 295/01")] and "evil" not in rows["html"].text
    assert short["md"] == [("law", "bgb", "433"), ("law", "vwgo", "154")] and short["null"] == short["empty"] == []
    assert short["multi"] == [("law", "bgb", "556d"), ("law", "bgb", "556e")]
    assert [(r.relation, r.span.text) for r in rows["rel"].relations] == [("ivm", "i.V.m.")]
    for r in rows.values():
        end = 0
        for c in r.citations:
            assert r.text[c.span.start : c.span.end] == c.span.text and c.span.start >= end and len(c.id) == 12
            end = c.span.end


def test_raw_spans(done):
    got = {r.doc_id: r.s for r in done.where(F.size("citations") > 0).select("doc_id", normalize.map_span_to_raw(F.col("citations")[0]["span"], F.col("omap"), F.col("raw")).alias("s")).collect()}
    assert got["html"].text == "&sect; 433 Abs. 1 BGB" and got["md"].text == "§ 433 Abs. 1 BGB" and got["plain"].text == "§ 433 BGB"


def test_options(spark):
    docs = spark.createDataFrame([(1, "Foo §§ 556d, 556e BGB bar, BGH 1 A 2/03 und BGHZ 77, 274 x")], "doc_id long, text string")
    one = extract(docs, normalize=False, multi_ref="collapse").first()
    assert [c.number for c in one.citations if c.type == "law"] == ["556d"]
    two = extract(docs, [law_engine(), case_engine(reporter_fields=True)], normalize=False).first()
    last = two.citations[-1]
    assert (last.kind, last.court, last.reporter, last.reporter_volume, last.reporter_page) == ("short", "BGH", "BGHZ", "77", "274")
    m = extract_markers(docs.withColumn("text", F.concat(F.lit("[ref=a-1]"), "text", F.lit("[/ref]"))), case=False).first()
    assert m.text.startswith("Foo") and len(m.markers) == 1 and len(m.markers[0].refs) == 2


def _cites(spark, *rows):
    parts = [citation(id=F.lit(i), type=F.lit(t), span=span(F.lit(a), F.lit(b), F.lit("")), confidence=F.lit(c), **{k: F.lit(v) for k, v in f.items()}) for i, t, a, b, c, f in rows]
    return spark.range(1).select(F.array(*parts).cast(f"array<{CITATION}>").alias("c"))


def test_overlaps_and_short_forms(spark):
    d = _cites(spark, ("a", "law", 0, 10, 0.5, {}), ("b", "law", 5, 15, 0.9, {}), ("c", "law", 14, 20, 0.9, {}), ("d", "law", 20, 22, 0.1, {}))
    assert [c.id for c in d.select(resolve_overlaps(F.col("c")).alias("x")).first().x] == ["b", "d"]
    d = _cites(spark, ("a", "law", 0, 1, 1.0, {"book": "bgb", "number": "433"}), ("b", "law", 2, 3, 1.0, {"number": "434"}), ("c", "case", 4, 5, 1.0, {"court": "BGH", "file_number": "x"}), ("d", "case", 6, 7, 1.0, {"reporter": "BGHZ"}), ("e", "case", 8, 9, 1.0, {"reporter": "BVerwGE"}))
    x = d.select(resolve_case(resolve_law(F.col("c"))).alias("x")).first().x
    assert [(c.kind, c.book, c.resolves_to) for c in x[:2]] == [("full", "bgb", None), ("short", "bgb", "a")]
    assert [(c.kind, c.court) for c in x[2:]] == [("full", "BGH"), ("short", "BGH"), ("full", None)]


def test_normalisers():
    assert normalize.html_to_text("<p>&#167; 433 BGB</p>")[0] == "§ 433 BGB" and normalize.html_to_text("<p>&#167; 433 BGB</p>")[1][0][:2] == (0, 3)
    assert normalize.html_to_text("a< >b<br")[0] == "ab" and normalize.html_to_text("")[0] == "" and normalize.html_to_text("x & y &amp;z")[0] == "x & y &z"
    assert normalize.html_to_text("<div>a</div>\n\n<div>b</div>")[0] == "a\n\nb"
    assert normalize.markdown_to_text("# T\n\n**b** _i_ `c` [l](u)")[0] == "T\n\nb i c l"
    for raw, (text, runs) in (("<p>a &ouml; 😀 <b>b</b></p>", normalize.html_to_text("<p>a &ouml; 😀 <b>b</b></p>")),):
        flat = [r + i for _, r, n in runs for i in range(n)]
        assert len(flat) == len(text) and all(raw[f] == c or raw[f] == "&" for f, c in zip(flat, text))


def test_formats_and_masks(spark):
    texts = ["# Title\n\nBody", "This is **bold** text", "  <div>content</div>", "nur Text", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.f for r in df.orderBy("i").select(normalize.detect_format(F.col("t")).alias("f")).collect()] == ["markdown", "markdown", "html", "plain", None]
    one = spark.createDataFrame([("Der (x y) am 12.03.2020 vgl. Abs. 3 Schl.-Holst. z",)], "text string")
    assert normalize.with_tokenizer_mask(one).first().masked == "Der _____ am __________ ____ ____ 3 ____________ z"
    from fundstelle.functions.dialect import mask_intervals

    spans = F.array(F.struct(F.lit(4).alias("start"), F.lit(9).alias("end")), F.struct(F.lit(2).alias("start"), F.lit(6).alias("end")))
    assert spark.range(1).select(mask_intervals(F.lit("hello world"), spans).alias("m")).first().m == "he_______ld"


def test_exports(done):
    import json

    line = json.loads(export.jsonl(done).where("doc_id = 'plain'").first().value)
    assert [c["type"] for c in line["citations"]] == ["law", "case"] and "book" not in line["citations"][1] and line["citations"][0]["book"] == "bgb"
    assert json.loads(export.pretty_json(done).where("doc_id = 'plain'").first().value)["doc_id"] == "plain"
    sp = export.spacy(done).where("doc_id = 'plain'").first()
    assert [(s.start_token, s.end_token, s.label) for s in sp.spans] == [(1, 4, "LAW_REF"), (6, 9, "CASE_REF")] and not sp.tokens[-1].space
    assert 'href="/akn/de/act/bgb/~433"' in export.akn(done).where("doc_id = 'plain'").first().akn
    note = json.loads(export.web_annotations(done, "u").where("doc_id = 'plain'").first().annotation)
    assert note["target"]["selector"]["type"] == "TextPositionSelector" and note["body"]["properties"]["book"] == "bgb"
    assert [s.label for s in export.gliner(done).where("doc_id = 'plain'").first().spans] == ["LAW_REF", "CASE_REF"]
    markers = done.where("doc_id = 'plain'").select(export.to_markers(F.col("citations")).alias("m")).first().m
    assert markers[0].refs[0].book == "bgb" and markers[1].refs[0].court == "BVerwG"


def test_tokens_and_labels(spark, done):
    rec = tokens.bio_records(done)
    one = rec.where("doc_id = 'plain'").first()
    assert one.ner_tags == ["O", "B-LAW_REF", "I-LAW_REF", "I-LAW_REF", "O", "O", "B-CASE_REF", "I-CASE_REF", "I-CASE_REF", "O", "O", "O"]
    assert tokens.bio_statistics(rec).first().documents == len(TEXTS)
    df = spark.createDataFrame([("Gemäß § 433 BGB gilt.", ["O", "B-GS", "I-RS", "I-GS", "O"]), ("a b c", ["I-GS", "X", "B-AZ"])], "text string, lab array<string>")
    x = df.withColumn("t", tokens.tokens(F.col("text"))).select("text", tokens.bio_spans(F.col("t"), tokens.map_labels(F.col("lab"))).alias("s"))
    x = x.select(tokens.model_citations(F.col("s"), F.col("text"), 0.8).alias("c")).collect()
    assert [(c.span.text, c.book, c.number, c.confidence) for c in x[0].c] == [("§ 433 BGB", "bgb", "433", 0.8)] and [c.type for c in x[1].c] == ["case"]
    shapes = spark.createDataFrame([(w,) for w in ("123", "12345", "BGB", "vom", "Urteil", "i.V.m.")], "w string").select("w", tokens.word_shape(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in shapes} == {"123": "ddd", "12345": "dddd", "BGB": "XX", "vom": "xx", "Urteil": "Xx", "i.V.m.": "xx"} or {r.w: r.s for r in shapes}["123"] == "ddd"
    assert tokens.windowed(lambda b: [["L"] * len(x) for x in b], 4, 1)([["a"] * 10]) == [["L"] * 10]

    def load():
        return lambda batch: [["B-LAW_REF" if t == "§" else "I-LAW_REF" if t in ("433", "BGB") else "O" for t in toks] for toks in batch]

    out = extract(done.select("doc_id", "text"), [tokens.tagger_engine(load)], normalize=False)
    assert [c.span.text for c in out.where("doc_id = 'plain'").first().citations] == ["§ 433 BGB"]


def _rows(done):
    return citation_rows(done).select("doc_id", "ord", "id", "type", "kind", F.col("span.start").alias("start"), F.col("span.end").alias("end"), F.col("span.text").alias("text"), "book", "number", "court", "file_number", "structure", "resolves_to")


def test_scores_and_checks(spark, done):
    gold = _rows(done)
    pred = gold.where("ord < 1").withColumn("end", F.col("end") + F.when(F.col("doc_id") == "rel", 1).otherwise(0))
    s = score.span_scores(gold, pred).first()
    n = gold.count()
    assert (s.tp, s.fp, s.fn) == (4, 1, n - 4)
    over = {r.type: (r.tp, r.fp, r.fn) for r in score.overlap_scores(gold, pred).collect()}
    assert over["all"] == (5, 0, n - 5)
    assert {r.field: r.accuracy for r in score.field_accuracy(gold, pred).collect()}["book"] == 1.0
    a = spark.createDataFrame([("x", 0, "c", "law", 0, 5, {"absatz": "1", "satz": "2"})], "doc_id string, ord int, id string, type string, start int, end int, structure map<string,string>")
    got = score.structure_accuracy(a, a.withColumn("structure", F.create_map().cast("map<string,string>"))).first()
    assert (got.missing_pred, got.accuracy) == (2, 0.0)
    assert score.field_accuracy_overlap(gold, pred).count() >= 2 and diagnose.near_misses(gold, pred).count() == 1
    assert diagnose.missed(gold, pred).count() == n - 4 and diagnose.invented(gold, pred).count() == 1
    rel = relation_rows(done)
    assert score.relation_scores(gold, rel, gold, rel).first().f1 == 1.0
    assert validate.validate(done.select("doc_id", "text"), gold, rel).count() == 0
    bad = gold.withColumn("kind", F.lit("odd"))
    assert {r.check for r in validate.validate(done.select("doc_id", "text").where("doc_id <> 'md'"), bad, rel.withColumn("target_id", F.lit("?"))).collect()} == {"kind", "join", "relation_end"}
    assert score.normal_field("court", F.lit("x")) is not None
    v = spark.range(1).select(score.normal_field("court", F.lit(" BAG 5. Senat ")).alias("v")).first().v
    assert v == "bag"


def test_adapted_spans(done):
    rows = adapt.markers_to_citations(extract_markers(done.select("doc_id", "text"))).orderBy("doc_id", "ord").collect()
    got = {(r.doc_id, r.id): r.text for r in rows}
    assert got[("plain", "p_002")] == "BVerwG 10 C 23.12" and got[("multi", "p_002")] == "556e BGB"
    assert got[("html", "p_002")] == "BGH, Urteil vom 12.03.2020 – VIII ZR 295/01"


def test_datasets_and_streams(spark, tmp_path, done):
    from fundstelle.streaming.extract import extract_stream, read_documents, write_jsonl

    folder = tmp_path / "set" / "dev"
    folder.mkdir(parents=True)
    (folder / "documents.jsonl").write_text('{"doc_id":"a","format":"plain","raw":"x","text":"x"}\n{"doc_id":"b","raw":"y"}\n')
    (folder / "annotations.jsonl").write_text('{"doc_id":"a","citations":[{"id":"1","type":"law"}],"relations":[]}\n{"doc_id":"a","citations":[{"id":"2","type":"law"}]}\n')
    rows = {r.doc_id: r for r in datasets.load_dataset(spark, str(tmp_path / "set"), "validation").collect()}
    assert rows["b"].citations is None and [(c.id, c.kind, c.confidence) for c in rows["a"].citations] == [("2", "full", 1.0)]
    with pytest.raises(FileNotFoundError):
        datasets.load_dataset(spark, str(tmp_path / "nothing"))
    parsed = datasets.parse_annotations(spark.createDataFrame([("a", '[{"id":"1"}]', "oops")], "doc_id string, citations string, relations string")).first()
    assert parsed.citations[0].kind == "full" and parsed.relations == []
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"doc_id":"1","raw":"nach § 433 BGB gilt"}\n', encoding="utf-8")
    q = write_jsonl(extract_stream(read_documents(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(120)
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 1 and '"number":"433"' in lines[0]
