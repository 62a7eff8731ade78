"""Regex matches with positions, as Spark expressions.

Spark returns strings but not where they stood. ``matches`` writes private-use marks around each match
and its groups, cuts at them, and sums up lengths; nothing leaves the JVM. Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, GROUP, CLOSE = "\ue000", "\ue001", "\ue002"
#: White space, letters and digits of all scripts; a dot stops at line feeds alone.
FLAGS = "(?Ud)"
MATCH = "array<struct<start:int,end:int,text:string,groups:array<string>,gap:string>>"

Lambda = Callable[[Column], Column]


def let(value: Column, body: Lambda) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that the optimiser neither repeats nor looks into.

    Filters and generators above would otherwise have the whole expression copied into them, one copy for each
    use, through every step of a chain. A generator of one element is a wall to that and costs a row copy.
    """
    return df.withColumn(name, F.explode_outer(F.array(value)))


def running_sums(numbers: Column) -> Column:
    """The sums of an array of integers up to each place.

    A fold copies all that it has made at every step; here each pass adds what stood 1, 2, 4, … places before.
    """
    reach = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(numbers) + 1)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(reach, numbers, lambda acc, d: F.transform(acc, lambda x, i: (x + F.coalesce(F.get(acc, i - d), F.lit(0))).cast("int")))


def guarded(text: Column) -> Column:
    """The text with the marks' own characters replaced one for one; a look for them is cheaper than a new text."""
    some = text.contains(OPEN) | text.contains(GROUP) | text.contains(CLOSE)
    return F.when(some, F.translate(text, OPEN + GROUP + CLOSE, "\ufffd" * 3)).otherwise(text)


def matches(text: Column, pattern: str, groups: Sequence[str] = ()) -> Column:
    """All matches, left to right, as ``MATCH``; ``gap`` is the text up to the next one.

    A group that took no part in the match is an empty string.
    """
    marked = F.regexp_replace(text, F.lit(FLAGS + pattern), F.lit(OPEN + "$0" + "".join(f"{GROUP}${{{g}}}" for g in groups) + CLOSE))

    def parse(x: Column) -> Column:
        return let(F.substring_index(x, CLOSE, 1), lambda head: F.struct(F.split(head, GROUP, -1).alias("p"), F.substr(x, F.length(head) + 2).alias("gap")))

    def place(parsed: Column, starts: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            body, start = x["p"][0], F.get(starts, i)
            return F.struct(start.alias("start"), (start + F.length(body)).alias("end"), body.alias("text"), F.slice(x["p"], 2, max(1, len(groups))).alias("groups"), x["gap"].alias("gap"))

        return F.transform(parsed, one)

    def found(parsed: Column, first: Column) -> Column:
        before = F.concat(F.array(first), F.transform(parsed, lambda x: F.length(x["p"][0]) + F.length(x["gap"])))
        return let(let(before, running_sums), lambda starts: place(parsed, starts))

    def collect(segments: Column) -> Column:
        rest = F.transform(F.slice(segments, F.lit(2), F.size(segments)), parse)
        return F.when(F.size(segments) > 1, let(rest, lambda x: found(x, F.length(segments[0])))).otherwise(F.array().cast(MATCH))

    return let(F.split(marked, OPEN, -1), collect)


def masked(text: Column, found: Column, use: Lambda | None = None) -> Column:
    """The text with the matches (those that ``use`` picks) overwritten by ``_``; lengths stay."""

    def part(m: Column) -> Column:
        blank = F.repeat(F.lit("_"), m["end"] - m["start"])
        return F.concat(blank if use is None else F.when(use(m), blank).otherwise(m["text"]), m["gap"])

    whole = F.concat(F.substr(text, F.lit(1), found[0]["start"]), F.array_join(F.transform(found, part), ""))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def mask_intervals(text: Column, spans: Column) -> Column:
    """The text with ``array<struct<start,end>>`` intervals overwritten by ``_``; they may overlap and come in any order."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))

    def step(acc: Column, s: Column) -> Column:
        start = F.greatest(acc["pos"], s["start"])
        end = F.greatest(start, F.least(s["end"], F.length(text)))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.substr(text, acc["pos"] + 1, F.greatest(F.lit(0), start - acc["pos"])), F.repeat(F.lit("_"), end - start)).alias("out"))

    return let(F.aggregate(ordered, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step), lambda r: F.concat(r["out"], F.substr(text, r["pos"] + 1)))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, F.greatest(F.lit(0), end - start))


def literal(s: str) -> str:
    """``s`` as a pattern for itself."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&#~" else c for c in s)


def trie(options: Sequence[Sequence[str]]) -> str:
    """One pattern for many, each given as pattern atoms; at any place the first that fits wins.

    Common beginnings are written once. An option that is the beginning of another stands before it or after
    it, as in the list.
    """

    def build(items: list[tuple[int, tuple[str, ...]]]) -> str:
        ends = [r for r, o in items if not o]
        if ends:
            before = [(r, o) for r, o in items if o and r < ends[0]]
            after = [(r, o) for r, o in items if o and r > ends[0]]
            parts = ([build(before)] if before else []) + [""] + ([build(after)] if after else [])
            return "(?:" + "|".join(parts) + ")" if len(parts) > 1 else ""
        heads: dict[str, list[tuple[int, tuple[str, ...]]]] = {}
        for r, o in items:
            heads.setdefault(o[0], []).append((r, o[1:]))
        parts = [h + build(rest) for h, rest in heads.items()]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    unique = {tuple(o): i for i, o in reversed(list(enumerate(options)))}
    return build(sorted((i, o) for o, i in unique.items()))
