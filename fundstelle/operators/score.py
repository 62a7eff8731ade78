"""Precision, recall and field accuracy of citation rows against gold rows.

Both tables have ``(doc_id, ord, id, type, start, end, book, number, court, file_number[, structure])``. Everything is
keyed by the document, so one partitioning by ``doc_id`` serves all joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundstelle.functions.dialect import fixed, let

FIELDS = {"law": ("book", "number"), "case": ("court", "file_number")}
_SENATE = r"(?iu)\s+\d+\.\s*(?:Kammer|(?:Familien|Kartell|Revisions|Straf|Zivil)?Senat)$"


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Counts and ratios; a ratio without cases is 0."""
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return [tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1")]


def last_by_span(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each span of a document: the last."""
    by = ["doc_id", "start", "end", *keys]
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), "ord").alias("x")).select(*by, "x.*")


def exact_pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``(doc_id, start, end, g, p)``: gold and predicted rows of equal spans, null where one lacks."""
    a, b = last_by_span(gold), last_by_span(pred)
    pack = lambda df, n: df.select("doc_id", "start", "end", F.struct(*[c for c in df.columns if c not in ("doc_id", "start", "end")]).alias(n))
    return pack(a, "g").join(pack(b, "p"), ["doc_id", "start", "end"], "full")


def _counts(pairs: DataFrame, *by: str) -> DataFrame:
    g, p = F.col("g").isNotNull(), F.col("p").isNotNull()
    sums = pairs.groupBy(*by).agg(F.count_if(g & p).alias("a"), F.count_if(~g & p).alias("b"), F.count_if(g & ~p).alias("c"))
    return sums.select(*by, *prf(F.col("a"), F.col("b"), F.col("c")))


def span_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Micro scores over distinct spans of all documents, one row."""
    return _counts(exact_pairs(gold, pred))


def span_scores_by_type(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """The same for law and case citations by themselves: ``(type, …)``."""
    side = lambda df, n: df.where(F.col("type").isin("law", "case")).select("doc_id", "start", "end", "type").distinct().withColumn(n, F.lit(True))
    return _counts(side(gold, "g").join(side(pred, "p"), ["doc_id", "start", "end", "type"], "full"), "type")


def _side(rows: DataFrame, name: str) -> DataFrame:
    cols = [c for c in ("end", "id", "type", "book", "number", "court", "file_number") if c in rows.columns]
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "ord", *cols))).alias(name))


def greedy_matches(gold: Column, pred: Column, same_type: bool = False) -> Column:
    """``array<struct<g,p>>`` of indexes: each predicted citation, by start, takes the first free gold one that it overlaps."""
    kind = "array<struct<g:int,p:int>>"
    numbered = F.transform(pred, lambda p, i: F.struct(p.alias("p"), i.alias("i")))

    def step(acc: Column, x: Column) -> Column:
        p = x["p"]
        free = F.filter(
            F.transform(gold, lambda g, i: F.when((g["start"] < p["end"]) & (p["start"] < g["end"]) & ((g["type"] == p["type"]) if same_type else F.lit(True)) & ~F.exists(acc, lambda m: m["g"] == i), i)),
            lambda i: i.isNotNull(),
        )
        return F.when(F.size(free) > 0, F.concat(acc, F.array(F.struct(free[0].alias("g"), x["i"].alias("p"))))).otherwise(acc)

    return F.aggregate(numbered, F.array().cast(kind), step)


def overlap_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Micro scores of overlaps, each gold citation counting once: ``(type, …)`` with type ``all``, ``law`` and ``case``."""
    both = _side(gold, "g").join(_side(pred, "p"), "doc_id", "full")
    kinds = ("all", "law", "case")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))

    def counts(kind: str) -> Column:
        pick = lambda c: F.col(c) if kind == "all" else F.filter(c, lambda x: x["type"] == kind)
        count = lambda g, p: F.struct(size(g).alias("g"), size(p).alias("p"), size(greedy_matches(g, p)).alias("n"))
        return let(pick("g"), lambda g: let(pick("p"), lambda p: count(g, p)))

    # all kinds in one pass: three tables would join and group everything three times
    one = fixed(both, "k", F.array(*[counts(k) for k in kinds]))
    total = lambda i, x: F.coalesce(F.sum(F.col("k")[i][x]), F.lit(0)).alias(x)
    sums = one.agg(F.array(*[F.struct(F.lit(k).alias("type"), *[total(i, x) for x in ("g", "p", "n")]) for i, k in enumerate(kinds)]).alias("k")).select(F.explode("k").alias("k")).select("k.*")
    return sums.select("type", *prf(F.col("n"), F.col("p") - F.col("n"), F.col("g") - F.col("n")))


def normal_field(name: str, value: Column) -> Column:
    """Trimmed and in lower case, empty as null; courts without their senate or chamber."""
    v = F.lower(F.trim(value))
    if name == "court":
        v = F.regexp_replace(v, _SENATE, "")
    return F.nullif(v, F.lit(""))


def field_outcome(name: str, gold: Column, pred: Column) -> Column:
    """``correct``, ``incorrect``, ``missing_pred`` (only gold has a value), ``missing_gold`` or null (neither)."""
    g, p = normal_field(name, gold), normal_field(name, pred)
    return F.when(g.isNotNull() & p.isNotNull(), F.when(g == p, "correct").otherwise("incorrect")).when(g.isNotNull(), "missing_pred").when(p.isNotNull(), "missing_gold")


def _accuracy(outcomes: DataFrame) -> DataFrame:
    """From ``(field, outcome)``: counts and the share of correct values where both sides have one."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    sums = outcomes.where("outcome is not null").groupBy("field").agg(*[n(o).alias(o) for o in ("correct", "incorrect", "missing_pred", "missing_gold")])
    total = F.col("correct") + F.col("incorrect") + F.col("missing_pred") + F.col("missing_gold")
    return sums.withColumn("accuracy", F.round(F.coalesce(F.try_divide(F.col("correct"), total), F.lit(0.0)), 6))


def _outcomes(pairs: DataFrame, suffix: str = "") -> DataFrame:
    parts = [F.when(F.col("g.type") == kind, F.struct(F.lit(name + suffix).alias("field"), field_outcome(name, F.col(f"g.{name}"), F.col(f"p.{name}")).alias("outcome"))) for kind, names in FIELDS.items() for name in names]
    return pairs.select(F.explode(F.array_compact(F.array(*parts))).alias("x")).select("x.*")


def field_accuracy(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``(field, correct, incorrect, missing_pred, missing_gold, accuracy)`` over citations of equal span, by the gold one's type."""
    return _accuracy(_outcomes(exact_pairs(gold, pred).where("g is not null and p is not null")))


def structure_accuracy(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """The same for the keys of ``structure`` of law citations of equal span."""
    pairs = exact_pairs(gold, pred).where("g is not null and p is not null and g.type = 'law'")
    empty = F.create_map().cast("map<string,string>")
    g, p = F.coalesce("g.structure", empty), F.coalesce("p.structure", empty)
    keys = pairs.select(g.alias("g"), p.alias("p"), F.explode(F.array_union(F.map_keys(g), F.map_keys(p))).alias("k"))
    a, b = F.try_element_at("g", F.col("k")), F.try_element_at("p", F.col("k"))
    outcome = F.when(a.isNotNull() & b.isNotNull(), F.when(F.lower(F.trim(a)) == F.lower(F.trim(b)), "correct").otherwise("incorrect")).when(a.isNotNull(), "missing_pred").otherwise("missing_gold")
    return _accuracy(keys.select(F.lit("structure").alias("field"), outcome.alias("outcome")))


def field_accuracy_overlap(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``field_accuracy`` over greedy overlap matches of one type; fields are named ``…_overlap``."""
    both = _side(gold, "g").join(_side(pred, "p"), "doc_id")
    matched = both.withColumn("m", greedy_matches(F.col("g"), F.col("p"), same_type=True)).select("g", "p", F.explode("m").alias("m"))
    return _accuracy(_outcomes(matched.select(F.get("g", F.col("m.g")).alias("g"), F.get("p", F.col("m.p")).alias("p")), "_overlap"))


def relation_scores(gold: DataFrame, gold_relations: DataFrame, pred: DataFrame, pred_relations: DataFrame) -> DataFrame:
    """Micro scores of distinct relations between spans; those with an unknown end don't count."""

    def triples(rows: DataFrame, rels: DataFrame, name: str) -> DataFrame:
        # each join behind a shuffle by its own keys: one by doc_id alone would serve all, but a task would then hold the sorts of all of them at once
        ids = rows.select("doc_id", "id", "start", "end", "ord").repartition("doc_id", "id").groupBy("doc_id", "id").agg(F.max_by(F.struct("start", "end"), "ord").alias("s"))
        ids = ids.select("doc_id", "id", (F.shiftleft(F.col("s.start").cast("long"), 32) + F.col("s.end")).alias("s"))
        a = ids.select("doc_id", F.col("id").alias("source_id"), F.col("s").alias("a"))
        b = ids.select("doc_id", F.col("id").alias("target_id"), F.col("s").alias("b"))
        out = rels.select("doc_id", "source_id", "target_id", "relation").repartition("doc_id", "source_id").join(a, ["doc_id", "source_id"])
        out = out.select("doc_id", "target_id", "relation", "a").repartition("doc_id", "target_id").join(b, ["doc_id", "target_id"])
        return out.select("doc_id", "a", "b", "relation", F.lit(name == "g").alias("g"), F.lit(name == "p").alias("p"))

    # a grouping behind a shuffle of its own, where a join of both sides would hold both and all their sorts in one task; structs make it sort, which takes half the memory of a hash table
    keys = ["doc_id", "a", "b", "relation"]
    both = triples(gold, gold_relations, "g").union(triples(pred, pred_relations, "p")).repartition(*keys)
    seen = both.groupBy(*keys).agg(F.max(F.struct("g"))["g"].alias("g"), F.max(F.struct("p"))["p"].alias("p"))
    same = F.col("g") & F.col("p") & F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("relation").isNotNull()
    sums = seen.agg(F.count_if(same).alias("tp"), F.count_if(F.col("p") & ~same).alias("fp"), F.count_if(F.col("g") & ~same).alias("fn"))
    return sums.select(*prf(F.col("tp"), F.col("fp"), F.col("fn")))


def timing_statistics(seconds: DataFrame, column: str = "seconds") -> DataFrame:
    """Count, total, mean, median, the values at 95 and 99 % of the sorted list, and the largest: one row."""
    sorted_ = F.array_sort(F.collect_list(F.col(column).cast("double")))
    n = F.size("s")
    at = lambda q: F.get("s", F.least(n - 1, F.floor(n * q).cast("int")))
    row = seconds.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(column), F.lit(0)).cast("double").alias("total"), F.avg(column).alias("mean"), F.percentile(F.col(column), 0.5).alias("median"), sorted_.alias("s"))
    return row.select("documents", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round(at(0.95), 6).alias("p95"), F.round(at(0.99), 6).alias("p99"), F.round(F.element_at("s", -1), 6).alias("max"))
