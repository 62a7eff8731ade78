import pytest
from pyspark.sql import functions as F

from fundstelle.operators.law import law_citations, with_context_markers, with_law_markers
from fundstelle.sources.lexicon import BASE_CODES, CitationError, LawLexicon, bundled, load_law_lexicon, merge_codes

GOLDEN = [
    ("wie in §§ 124 Abs. 2 Nr. 3, 124 a Abs. 1 Satz 1 VwGO wegen", ["vwgo/124", "vwgo/124a"]),
    ("aus § 167 VwGO i.V.m. §§ 708 Nr. 11, 711 ZPO.", ["vwgo/167", "zpo/708", "zpo/711"]),
    ("(§ 34 Abs. 2 BauGB) Baugebiete nach §§ 2 bis 4 BauNVO, die", ["baugb/34", "baunvo/2", "baunvo/3", "baunvo/4"]),
    ("aus § 154 Abs. 1 VwGO. Das (vgl. §§ 162 Abs. 3, 154 Abs. 3 VwGO).", ["vwgo/154", "vwgo/154", "vwgo/162"]),
    ("nach § 42 Abs. 1 Alt. 1 VwGO bezüglich", ["vwgo/42"]),
    ("§ 77 Abs. 1 Satz 1, 1. Halbsatz AsylG ist", ["asylg/77"]),
    ("§§ 52 Abs. 1; 53 Abs. 2 Nr. 1; 63 Abs. 2 StPO ", ["stpo/52", "stpo/53", "stpo/63"]),
    ("Art 12 Abs 1 GG und Art. 1, 2, 3 GG.", ["gg/1", "gg/12", "gg/2", "gg/3"]),
    ("Foo §§ 556d, 556e BGB bar.", ["bgb/556d", "bgb/556e"]),
    ("§§ 1, 2 Abs. 2, 3, 10 Abs. 1 Nr. 1 BGB foo.", ["bgb/1", "bgb/10", "bgb/2", "bgb/3"]),
    ("§ 3d AsylG, und § 123 VwGO. Und §§ 3, 3b AsylG</p>", ["asylg/3", "asylg/3b", "asylg/3d", "vwgo/123"]),
    ("§ 136 Abs 1 Nr 6 SGG erf. § 48 Abs 1 Satz 2 Nr 4 SGB X keine", ["sgb x/48", "sgg/136"]),
    ("unter § 8 Absatz 1 Nummern 1 bis 6 des deutschen Außensteuergesetzes fallenden", ["außensteuergesetz/8"]),
    ("§ 40 des Verwaltungsverfahrensgesetzes ist", ["verwaltungsverfahrensgesetz/40"]),
    ("§ 343 der Zivilprozessordnung kann", ["zivilprozessordnung/343"]),
    ("Diese Art der Beweisführung ist unzulässig.", []),
    ("nach § 42 Abs. 1 VwGO bezüglich", ["vwgo/42"]),
    ("zuletzt § 1 BGB", []),
    ("§ 3 Abs. 1 Nr. 1 i.V.m. § 3b AsylG, und", ["asylg/3b"]),
    ("§ 12 gilt auch nach dem BGB nicht", ["bgb/12"]),
    ("§§ 3a Abs. 1 und 2, 4 BGB gilt", ["bgb/2", "bgb/3a", "bgb/4"]),
]


def refs(df, column="markers"):
    rows = df.select("i", F.explode_outer(column).alias("m")).select("i", F.explode_outer("m.refs").alias("r")).where("r is not null").collect()
    out = {}
    for r in rows:
        out.setdefault(r.i, []).append(f"{r.r.book}/{r.r.section}")
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, text string")
    html = df.withColumn("text", F.replace("text", F.lit("§"), F.lit("&#167;")))
    return refs(with_law_markers(df)), refs(with_law_markers(html, html=True))


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(found, i):
    assert found[0].get(i, []) == GOLDEN[i][1]


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden_with_entities(found, i):
    assert found[1].get(i, []) == GOLDEN[i][1]


def test_context_of_one_book(spark):
    df = spark.createDataFrame([(0, "§§ 664 bis 670"), (1, "§§ 10 und 12"), (2, "Anlage 3"), (3, "&#167; 343"), (4, "§ 1 Abs. 2 Satz 3 und § 5"), (5, None), (6, "§§ 9 bis 2")], "i int, text string")
    got = refs(with_context_markers(df, "sgb"))
    assert got[0] == [f"sgb/{n}" for n in range(664, 671)] and got[1] == ["sgb/10", "sgb/11", "sgb/12"]
    assert got[2] == ["sgb/anlage-3"] and got[3] == ["sgb/343"] and got[4] == ["sgb/1", "sgb/5"] and 5 not in got and 6 not in got


def test_units_and_spans(spark):
    df = spark.createDataFrame([(0, "§ 3 GG ist, Art. 3 BGB und Art. 5 AEG 1994, so")], "i int, text string")
    cites = with_law_markers(df).select("text", law_citations(F.col("markers")).alias("c")).first()
    assert {(c.book, c.unit, c.delimiter) for c in cites.c} == {("gg", "article", "Art."), ("bgb", "paragraph", "§"), ("aeg 1994", "article", "Art.")}
    assert all(cites.text[c.span.start : c.span.end] == c.span.text for c in cites.c)


def test_long_inputs_neither_overflow_nor_hang(spark):
    texts = ["§ 1 " + "a b " * 20_000, "§ 1 " + "Abs. " * 4_000 + "BGB ", "§ 5 " + " ".join(["12345"] * 300), "§§ " + ", ".join(map(str, range(3000))), "§§ 1 bis 99999999999999999999 BGB x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = refs(with_law_markers(df))
    assert got.get(0, []) == got.get(2, []) == got.get(3, []) == [] and got[1] == ["bgb/1"]
    assert got[4] == ["bgb/1", "bgb/99999999999999999999"]


def test_wide_ranges_and_long_clauses_are_whole(spark):
    texts = ["§§ 1 bis 20000 BGB gilt", "§ 7 " + "Abs. 1 Satz 2, " * 80 + "Nr. 3 Halbsatz 1 BGB gilt", "Art. 5 " + "Abs. 1 Nr. 2 S. 3 " * 300 + " GG gilt", "§ 1 Abs. 1 Hals 2 BGB gilt", "§§ 1 bis 200000 BGB gilt"]
    got = refs(with_law_markers(spark.createDataFrame(list(enumerate(texts)), "i int, text string")))
    assert sorted(got[0], key=lambda r: int(r.split("/")[1])) == [f"bgb/{n}" for n in range(1, 20_001)]
    assert got[1] == ["bgb/7"] and got[2] == ["gg/5"] and got.get(3, []) == [] and got[4] == ["bgb/1", "bgb/200000"]
    spans = with_law_markers(spark.createDataFrame([(0, texts[0])], "i int, text string")).select(F.size(law_citations(F.col("markers")))).first()[0]
    assert spans == 20_000
    context = with_context_markers(spark.createDataFrame([(0, "§§ 1 bis 10001 x"), (1, "§§ 3 bis 300000 x"), (2, "§§ 9 bis 3 x")], "i int, text string"), "zpo")
    rows = {r.i: [x.section for m in r.markers for x in m.refs] for r in context.collect()}
    assert rows[0] == [str(n) for n in range(1, 10_002)] and rows[1] == ["3", "300000"] and rows[2] == []


def test_marks_in_the_input_do_no_harm(spark):
    df = spark.createDataFrame([(0, "§ 1 BGB x 😀 § 2 BGB y")], "i int, text string")
    row = with_law_markers(df).first()
    assert [(row.text[m.start : m.end]) for m in row.markers] == ["§ 1 BGB", "§ 2 BGB"] or [m.text for m in row.markers] == ["§ 2 BGB"]


def test_lexicon():
    lex = bundled()
    assert len(lex.codes) > 1900 and lex.unit_hint("gg") == "article" and lex.unit_hint(None) is None and lex.unit_hint("nope") is None
    assert merge_codes(["bgb", "XyzG", "xyzg"])[-1] == "XyzG" and len(merge_codes(["bgb"])) == len(BASE_CODES)
    with pytest.raises(CitationError):
        LawLexicon(()).book_pattern()
    for bad in ({"optional": True}, {"group_name": True}):
        with pytest.raises(ValueError):
            lex.book_pattern(**bad)
    assert lex.with_codes(None).codes == BASE_CODES and lex.with_codes(["A"]).codes == ("A",)


@pytest.mark.parametrize("value,precise", [("0", False), ("false", False), ("False", False), ("", False), ("1", True), ("yes", True)])
def test_switch_to_the_generic_pattern(monkeypatch, value, precise):
    monkeypatch.setenv("CITATIONS_PRECISE_BOOKS", value)
    assert load_law_lexicon().precise is precise


def test_lexicon_from_lines(tmp_path):
    path = tmp_path / "codes.txt"
    path.write_text("FooG\tArticle\n\n  \nBarG\tother\nBGB\tparagraph\n", encoding="utf-8")
    lex = load_law_lexicon(path)
    assert lex.unit_hint("foog") == "article" and lex.unit_hint("BarG") is None and lex.codes[-2:] == ("FooG", "BarG")
    assert load_law_lexicon(tmp_path / "none.txt").codes == BASE_CODES
