"""One list of citations of a document from several engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundstelle.functions.dialect import let
from fundstelle.schema import CITATION

LIST = f"array<{CITATION}>"


def resolve_overlaps(citations: Column) -> Column:
    """Disjoint citations in order of start (longer ones, then earlier ones first).

    What overlaps the last one kept takes its place if its confidence is higher, and goes otherwise.
    """
    keyed = F.transform(citations, lambda c, i: F.struct(c["span"]["start"].alias("start"), (c["span"]["start"] - c["span"]["end"]).alias("less"), i.alias("i")))

    def step(acc: Column, k: Column) -> Column:
        c = F.get(citations, k["i"])
        keep = c["span"]["start"] >= acc["end"]
        better = c["confidence"] > F.get(citations, F.element_at(acc["at"], -1))["confidence"]
        at = F.when(keep, F.concat(acc["at"], F.array(k["i"]))).when(better, F.concat(F.slice(acc["at"], F.lit(1), F.size(acc["at"]) - 1), F.array(k["i"]))).otherwise(acc["at"])
        return F.struct(at.alias("at"), F.when(keep | better, c["span"]["end"]).otherwise(acc["end"]).alias("end"))

    zero = F.struct(F.array().cast("array<int>").alias("at"), F.lit(-1).alias("end"))
    order = F.aggregate(F.array_sort(keyed), zero, step)["at"]
    return let(order, lambda at: F.transform(at, lambda i: F.get(citations, i))).cast(LIST)


def add_missing(first: Column, second: Column) -> Column:
    """``first`` and those of ``second`` that overlap none of it."""
    free = F.filter(second, lambda c: ~F.exists(first, lambda k: (c["span"]["start"] < k["span"]["end"]) & (k["span"]["start"] < c["span"]["end"])))
    return F.concat(first, free).cast(LIST)


def ensemble(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Citation rows of ``rules`` and those of ``model`` that overlap none of the same document, as an interval anti join."""
    a = rules.select(F.col("doc_id").alias("__d"), F.col("span.start").alias("__s"), F.col("span.end").alias("__e"))
    free = model.join(a, (model["doc_id"] == F.col("__d")) & (model["span"]["start"] < F.col("__e")) & (F.col("__s") < model["span"]["end"]), "left_anti")
    return rules.unionByName(free)
