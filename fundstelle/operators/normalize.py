"""Plain text of HTML and Markdown, with maps back to the raw input."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundstelle.functions.dialect import fixed, let, mask_intervals, matches, slice_text

#: Runs of text whose raw characters follow each other.
OMAP = "array<struct<text_start:int,raw_start:int,len:int>>"
NORMALIZED = f"struct<text:string,omap:{OMAP}>"
FORMATS = ("plain", "html", "markdown")
BLOCK_TAGS = frozenset("article blockquote br dd div dt h1 h2 h3 h4 h5 h6 hr li p pre section tr".split())
HIDDEN_TAGS = frozenset(("head", "script", "style"))
_TOKEN = re.compile(r"<[^>]*>?|&|[^<&]+")


def _around(sign: str) -> str:
    """Text between one or two of a sign on either side."""
    return f"{sign}{{1,2}}([^{sign}]+){sign}{{1,2}}"


_MARKS = (
    (re.compile(r"(?m)^#{1,6}\s+"), None),
    (re.compile(_around(r"\*")), 1),
    (re.compile(_around("_")), 1),
    (re.compile("`(?P<code>[^`]+)`"), 1),
    (re.compile(r"\[(?P<shown>[^\]]+)\]\((?:[^)]+)\)"), 1),
)


def detect_format(raw: Column) -> Column:
    """``html``, ``markdown`` or ``plain`` by the first 256 characters; null for null."""
    head = F.substring(raw, 1, 256)
    is_html = head.rlike(r"(?U)^\s*<") | head.rlike(r"(?Ui)<[a-z]+[\s>]")
    is_md = head.rlike(r"(?Udm)^#{1,6}\s") | head.contains("**") | head.contains("__")
    return F.when(raw.isNull(), F.lit(None)).when(is_html, "html").when(is_md, "markdown").otherwise("plain")


def _runs(offsets: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(offsets):
        return []
    cut = np.append(0, np.flatnonzero(np.diff(offsets) != 1) + 1)
    size = np.diff(np.append(cut, len(offsets)))
    return list(zip(cut.tolist(), offsets[cut].tolist(), size.tolist()))


def _stripped(text: str, offsets: np.ndarray) -> tuple[str, list[tuple[int, int, int]]]:
    left = len(text) - len(text.lstrip())
    out = text.strip()
    return out, _runs(offsets[left : left + len(out)])


def html_to_text(raw: str) -> tuple[str, list[tuple[int, int, int]]]:
    """Text without tags, scripts, styles and head, and its runs.

    A tag ends at the next ``>`` (or with the text); block tags, opening or closing, become line feeds;
    an entity that ends within 12 characters is decoded and stands where its ``&`` does. Then runs of blanks shrink
    to one, those of line feeds to two, and both ends are trimmed.
    """
    parts: list[str] = []
    where: list[np.ndarray] = []
    depth = at = 0

    def put(s: str, start: int, step: int) -> None:
        parts.append(s)
        where.append(start + step * np.arange(len(s)))

    n = len(raw)
    while at < n:
        token = _TOKEN.match(raw, at).group()  # type: ignore[union-attr]
        if token[0] == "<":
            inner = token[1:-1]
            words = inner.lstrip("/").split()
            name = words[0].lower().partition("/")[0] if words else ""
            if name in HIDDEN_TAGS:
                depth = max(0, depth - 1) if inner.startswith("/") else depth + 1
            if name in BLOCK_TAGS and not depth:
                put("\n", at, 0)
            at += len(token)
        elif token == "&" and not depth:
            semi = raw.find(";", at, min(at + 12, n))
            if semi >= 0:
                put(html.unescape(raw[at : semi + 1]), at, 0)
                at = semi + 1
            else:
                put("&", at, 0)
                at += 1
        else:
            if not depth:
                put(token, at, 1)
            at += len(token)
    text = "".join(parts)
    if not text:
        return "", []
    offsets = np.concatenate(where)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank, feed = (code == 32) | (code == 9), code == 10
    keep = np.ones(len(code), bool)
    keep[1:] &= ~(blank[1:] & blank[:-1])
    keep[2:] &= ~(feed[2:] & feed[1:-1] & feed[:-2])
    shown = np.where(blank, 32, code).astype(np.uint32)[keep]
    return _stripped(shown.tobytes().decode("utf-32-le", "surrogatepass"), offsets[keep])


def markdown_to_text(raw: str) -> tuple[str, list[tuple[int, int, int]]]:
    """Text without headings' signs, emphasis, code marks and link targets, rewritten one after the other, and its runs."""
    text, offsets = raw, np.arange(len(raw))
    for pattern, group in _MARKS:
        keep = np.ones(len(text), bool)
        for m in pattern.finditer(text):
            keep[m.start() : m.end()] = False
            if group:
                keep[m.start(group) : m.end(group)] = True
        if not keep.all():
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            text, offsets = code[keep].tobytes().decode("utf-32-le", "surrogatepass"), offsets[keep]
    return _stripped(text, offsets)


def _normalize(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for raw, fmt in batches:
        texts, maps = [], []
        for r, f in zip(raw, fmt):
            text, runs = (None, None) if r is None else html_to_text(r) if f == "html" else markdown_to_text(r)
            texts.append(text)
            maps.append(None if runs is None else [{"text_start": a, "raw_start": b, "len": c} for a, b, c in runs])
        yield pd.DataFrame({"text": texts, "omap": maps})


def with_normalized(df: DataFrame) -> DataFrame:
    """Add ``format`` (if it's missing or null: detected), ``text`` and ``omap`` to a table with ``raw``.

    Plain text, and that of unknown formats, is ``raw`` itself with a null map. A ``text`` that is there and isn't empty is kept.
    Positions in HTML and Markdown come of character-level state that Spark's expressions don't hold, so these rows
    go through Arrow batches; plain rows send nothing there.
    """
    raw = F.col("raw")
    fmt = F.coalesce(F.col("format"), detect_format(raw)) if "format" in df.columns else detect_format(raw)
    given = F.col("text") if "text" in df.columns else F.lit(None).cast("string")
    cur = df.withColumn("format", fmt).withColumn("__given", F.nullif(given, F.lit("")))
    marked = F.col("format").isin("html", "markdown") & F.col("__given").isNull()
    plain_text = F.pandas_udf(_normalize, NORMALIZED)  # type: ignore[call-overload]
    cur = cur.withColumn("__n", plain_text(F.when(marked, raw), F.col("format")))
    return cur.withColumn("text", F.coalesce("__given", "__n.text", raw)).withColumn("omap", F.col("__n.omap")).drop("__n", "__given")


def map_span_to_raw(s: Column, omap: Column, raw: Column) -> Column:
    """The span in the raw input; unchanged without a map or outside of it."""

    def at(i: Column) -> Column:
        run = F.filter(omap, lambda r: (r["text_start"] <= i) & (i < r["text_start"] + r["len"]))[0]
        return run["raw_start"] + i - run["text_start"]

    last = F.element_at(omap, -1)
    size = F.when(F.size(omap) > 0, last["text_start"] + last["len"]).otherwise(0)
    start = at(s["start"])
    end = F.when(s["end"] > s["start"], at(s["end"] - 1) + 1).otherwise(start)
    inside = omap.isNotNull() & (s["start"] < size) & (s["end"] <= size)
    made = let(F.struct(start.alias("a"), end.alias("b")), lambda p: F.struct(p["a"].cast("int").alias("start"), p["b"].cast("int").alias("end"), slice_text(raw, p["a"], p["b"]).alias("text")))
    return F.when(F.coalesce(inside, F.lit(False)), made).otherwise(F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["text"].alias("text")))


def remove_markers(text: Column) -> Column:
    """Text within ``[ref=…]…[/ref]`` without the tags."""
    return F.regexp_replace(text, F.lit(r"(?d)\[ref=[-a-z0-9]+\](.*?)\[/ref\]"), F.lit("$1"))


_ABBREVIATED = "|".join(("[0-9]+", "[IVX]+", "[A-Za-z]", *"Abs Art Nr Rn Rspr Urt bzw ca ff lfd sog std vgl".split()))


def with_tokenizer_mask(df: DataFrame, text: str = "text", out: str = "masked") -> DataFrame:
    """Add ``out``: the text with what splits sentences wrongly overwritten by ``_``: brackets, dates, abbreviations, ``Schl.-Holst.``."""
    cur = df.withColumn(out, F.col(text))
    for pattern, skip in ((r"\(.*?\)", 0), (r"(?:[0-9]+\.[0-9]+\.[0-9]+|i\.S\.d\.)", 0), (rf"[\s(\[](?:{_ABBREVIATED})\.", 1), (r"(?i)[a-z]+\.-[a-z]+\.", 0)):
        cur = fixed(cur, "__m", matches(F.col(out), pattern))
        spans = F.transform("__m", lambda m: F.struct((m["start"] + skip).alias("start"), m["end"].alias("end")))  # noqa: B023
        cur = fixed(cur, out, mask_intervals(F.col(out), spans)).drop("__m")
    return cur
