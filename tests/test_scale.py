"""Steps that were quadratic in a document's length, against brute force."""

import re
import time

from pyspark.sql import functions as F

from fundstelle.functions.dialect import guarded, matches
from fundstelle.operators import score, tokens
from fundstelle.operators.case import with_case_markers
from fundstelle.schema import CITATION, citation, span

WORDS = " ".join(f"w{i}" for i in range(60_000))


def test_positions_of_matches(spark):
    texts = ["", "a", " a", "aa  bb ", "x1y22z333", "\U0001f600 \ue000ü1 2\n3", WORDS[:5000]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for pattern, groups, python in ((r"\S+", (), r"\S+"), (r"(?<d>[0-9])(?<e>[a-z])?", ("d", "e"), r"(?P<d>[0-9])(?P<e>[a-z])?")):
        for r in rows.select("i", matches(guarded(F.col("t")), pattern, groups).alias("m")).collect():
            text = texts[r.i].replace("\ue000", "\ufffd")
            found = list(re.finditer(python, text))
            gaps = [text[m.end() : n] for m, n in zip(found, [m.start() for m in found[1:]] + [len(text)])]
            assert [(m.start, m.end, m.text, m.gap) for m in r.m] == [(m.start(), m.end(), m[0], g) for m, g in zip(found, gaps)]
            assert not groups or [list(m.groups) for m in r.m] == [[m[g] or "" for g in groups] for m in found]


def test_tokens_of_a_long_text(spark):
    rows = spark.createDataFrame([(WORDS,)], "t string")
    began = time.time()
    last = rows.select(F.element_at(tokens.tokens(F.col("t")), -1).alias("x")).first().x
    assert (last.text, last.start) == ("w59999", WORDS.rindex("w59999")) and time.time() - began < 30


def test_labels_and_spans_of_a_long_text(spark):
    at = [WORDS.index(f"w{i}") for i in (100, 30_000, 59_000)]
    cites = [(WORDS.index(f"w{i}"), WORDS.index(f" w{i + 600}")) for i in (100, 30_000, 59_000)]
    made = F.array(*[citation(id=F.lit(str(a)), type=F.lit("law"), span=span(F.lit(a), F.lit(b), F.lit("")), confidence=F.lit(1.0)) for a, b in cites]).cast(f"array<{CITATION}>")
    rows = spark.createDataFrame([(WORDS,)], "t string").withColumn("tok", tokens.tokens(F.col("t"))).withColumn("c", made).cache()
    rows.count()
    began = time.time()
    labelled = rows.withColumn("lab", tokens.bio_labels(F.col("tok"), F.filter("c", lambda c: c["type"] == "law"))).cache()
    got = labelled.first().lab
    assert [i for i, x in enumerate(got) if x == "B-LAW_REF"] == [100, 30_000, 59_000] and got.count("I-LAW_REF") == 3 * 599
    spans = labelled.select(tokens.bio_spans(F.col("tok"), tokens.map_labels(F.col("lab"))).alias("s")).first().s
    assert [(s.start, s.end) for s in spans] == cites and [s.start for s in spans] == at and time.time() - began < 60


def test_spans_of_odd_labels(spark):
    def slow(labels):
        out, going = [], False
        for i, x in enumerate(labels):
            if (x or "O").startswith("B-"):
                out.append([i, i])
            elif (x or "O").startswith("I-") and going:
                out[-1][1] = i
            going = (x or "O").startswith("B-") or ((x or "O").startswith("I-") and going)
        return [(2 * a, 2 * b + 1) for a, b in out]

    names = ["O", "B-LAW_REF", "I-LAW_REF", "I-CASE_REF", None]
    lists = [[names[(k // 5**j) % 5] for j in range(4)] for k in range(625)] + [["B-LAW_REF", "I-LAW_REF"], []]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, lab array<string>")
    for r in rows.select("i", tokens.bio_spans(tokens.tokens(F.lit("a b c d")), F.col("lab")).alias("s")).collect():
        assert [(s.start, s.end) for s in r.s] == slow(lists[r.i])


def test_addresses_and_dates_are_no_file_numbers(spark):
    texts = {
        "+1 (323) 555-4668 Nden 71.78.223.65 ha": [], "4375968545114388 Heit 83.249.81.32 er": [], "5380 Is 22.162.135.192 x": [], "10.0.81.32 Ab 83.24.81.32": [], "am 3 Mai 12.10.2012 war": [],
        "BVerwG 7 A 9.19 - Urteil": ["7 A 9.19"], "(10 C 23.12). Am": ["10 C 23.12"], "1 K 5137/16.A": ["1 K 5137/16"], "VIII ZR 295/01.2 x": ["VIII ZR 295/01"], "21 B 16.30364": ["21 B 16.30"],
    }
    rows = spark.createDataFrame(list(texts.items()), "text string, __x array<string>").drop("__x")
    assert {r.text: [m.text for m in r.markers] for r in with_case_markers(rows).collect()} == texts


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _scored(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, ord int, id string, type string, start int, end int")


GOLD = [(1, 1, "a", "law", 0, 5), (1, 2, "b", "case", 10, 15), (1, 3, "b", "case", 20, 25), (2, 1, "a", "law", 0, 5)]
PRED = [(1, 1, "x", "law", 0, 5), (1, 2, "y", "case", 22, 30), (3, 1, "a", "law", 1, 2)]


def test_relations_are_not_joined_in_one_stage(spark):
    kind = "doc_id long, source_id string, target_id string, relation string"
    gold = spark.createDataFrame([(1, "a", "b", "vgl"), (1, "a", "b", "vgl"), (1, "b", "a", "ivm"), (1, "a", "b", None), (2, "a", "zz", "vgl")], kind)
    pred = spark.createDataFrame([(1, "x", "y", "vgl"), (1, "y", "x", None)], kind)
    # gold: a->b (20, 25) once, b->a, a->b without a name; the end zz is unknown; y ends elsewhere than b
    got = score.relation_scores(_scored(spark, GOLD), gold, _scored(spark, PRED), pred)
    assert "FullOuter" not in _plan(got) and tuple(got.first())[:3] == (0, 2, 3)
    same = score.relation_scores(_scored(spark, GOLD), gold, _scored(spark, GOLD), gold)
    assert tuple(same.first())[:3] == (2, 1, 1)  # what has no name equals nothing


def test_overlaps_in_one_pass(spark):
    got = score.overlap_scores(_scored(spark, GOLD), _scored(spark, PRED))
    assert {r.type: (r.tp, r.fp, r.fn) for r in got.collect()} == {"all": (2, 1, 2), "law": (1, 1, 1), "case": (1, 0, 1)}
    assert _plan(got).count("FullOuter") <= 2  # with AQE a plan may be written twice
