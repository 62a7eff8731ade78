"""Law references: multi-section, single, full-name and article forms, phase by phase with masking.

A phase finds its matches in the text that earlier phases left and overwrites them. All of it is one
Spark expression for each document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundstelle.functions.dialect import fixed, guarded, let, masked, matches
from fundstelle.schema import CITATION, MARKER, citation, citation_id, span
from fundstelle.sources.lexicon import LawLexicon, bundled

REF = "array<struct<book:string,section:string,court:string,file_number:string>>"
#: Sections of one range that a row's array can hold with all that is made of it; of a wider one both ends are kept.
MAX_RANGE = 100_000
#: What may stand between a section and its book: any of these characters, and the words for parts of a section (Abs, Alt,
#: Satz, S., Halbsatz, Nr), in any number. A step of one sign makes it a loop without recursion: a word's first letter
#: must have the rest behind it, which the free characters take.
BETWEEN = r"(?:(?!A(?!bs|lt)|S(?!atz|\.)|H(?!albsatz)|N(?!r))[0-9a-zIXV.,;\sASHN])*"
SECTION = r"(?<sect>[0-9]+\s?[a-z]?)"
_NAME_ENDS = "gesetz(?:es|buch(?:es)?)?|(?:ver)?ordnung|verfassung"
SPLITTER = r"(?<sep>§§|&#167;&#167;|[,;]|und|bis)\s?(?<sect>[0-9]+\s(?=bis|und)|[0-9]+\s?[a-z]|[0-9]+)"


@dataclass(frozen=True)
class Phase:
    name: str
    pattern: str
    groups: tuple[str, ...]


def phases(lexicon: LawLexicon, html: bool = False) -> list[Phase]:
    """The patterns in their order. Old HTML input has the section sign as an entity; entities of delimiters begin with ``&``, which is one."""
    book = lexicon.book_pattern()
    sign = "&#167;" if html else "§"
    gap = r"\s"
    # every pattern ends before one of these; there is none at the end of the text
    ahead = r"(?=[\s.,;:!?()\[\]\"'<>&])"
    named = f"(?<book>{book})"
    article = r"Art(?:ikel|\.?)\s"
    number = r"[0-9]+\s?[a-z]?"
    return [
        Phase("multi", rf"{sign}{sign}{gap}[-§,;./ 0-9A-ZÄÖÜa-zäöü]{{4,200}}\s{book}{ahead}", ()),
        Phase("direct", rf"{sign}{gap}{SECTION} {named}{ahead}", ("sect", "book")),
        Phase("clause", rf"{sign}{gap}{SECTION} Abs. [0-9]+ Alt. [0-9]+ {named}{ahead}", ("sect", "book")),
        Phase("any", rf"{sign}{gap}{SECTION} {BETWEEN} {named}{ahead}", ("sect", "book")),
        Phase("full name", rf"{sign}{gap}{SECTION}.{{0,80}}?\sde[sr]\s(?:[a-zäöü][äöüßa-z]+\s)*(?<book>[ÄÖÜA-Z][äöüßÄÖÜA-Za-z]+?(?:{_NAME_ENDS})){ahead}", ("sect", "book")),
        Phase("articles", rf"{article}(?<body>{number}(?:\s*(?:[,;]|und|bis)\s+{number})+)\s+{named}{ahead}", ("body", "book")),
        Phase("article", rf"{article}{SECTION}{BETWEEN}\s+{named}{ahead}", ("sect", "book")),
    ]


def clean_book(book: Column) -> Column:
    return F.lower(F.trim(book))


def clean_section(section: Column) -> Column:
    return F.lower(F.replace(section, F.lit(" "), F.lit("")))


def _ref(book: Column, section: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(book.alias("book"), section.alias("section"), none.alias("court"), none.alias("file_number"))


def _digits(x: Column) -> Column:
    return x.rlike("^[0-9]+$")


def multi_references(text: Column, lexicon: LawLexicon) -> Column:
    """The references of one multi-section marker.

    A section belongs to the marker's only book, or else to the first book behind it; ``bis`` between whole
    numbers fills in the sections in between.
    """

    def collect(sections: Column, books: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            later = F.filter(books, lambda b: b["start"] > s["start"])
            book = F.when(F.size(books) == 1, books[0]["text"]).when(F.size(later) > 0, later[0]["text"])
            raw = s["groups"][1]

            def add(b: Column) -> Column:
                last = F.element_at(acc, -1)["section"]
                low, high = last.try_cast("long") + 1, raw.try_cast("long") - 1
                ranged = (s["groups"][0] == "bis") & (F.size(acc) > 0) & _digits(raw) & _digits(last) & (low <= high) & (high - low < MAX_RANGE)
                filled = F.transform(F.sequence(low, high), lambda n: _ref(clean_book(b), n.cast("string")))
                one = F.array(_ref(clean_book(b), clean_section(raw)))
                return F.when(b.isNull(), acc).when(F.coalesce(ranged, F.lit(False)), F.concat(acc, filled, one)).otherwise(F.concat(acc, one))

            return let(book, add)

        return F.aggregate(sections, F.array().cast(REF), step)

    return let(matches(text, SPLITTER, ("sep", "sect")), lambda s: let(matches(text, lexicon.book_pattern()), lambda b: collect(s, b)))


def _references(phase: Phase, m: Column, lexicon: LawLexicon) -> Column:
    g = m["groups"]
    if phase.name == "multi":
        return multi_references(m["text"], lexicon)
    if phase.name == "articles":
        number = F.regexp_extract_all(g[0], F.lit("(?U)([0-9]+\\s?[a-z]?)"), F.lit(1))
        return F.transform(number, lambda n: _ref(clean_book(g[1]), clean_section(F.trim(n))))
    book = clean_book(g[1])
    if phase.name == "full name":
        book = F.when(F.endswith(book, F.lit("gesetzes")) | F.endswith(book, F.lit("gesetzbuches")), F.left(book, F.length(book) - 2)).otherwise(book)
    return F.array(_ref(book, clean_section(F.trim(g[0]))))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def with_law_markers(df: DataFrame, text: str = "text", out: str = "markers", lexicon: LawLexicon | None = None, html: bool = False) -> DataFrame:
    """Add ``out``: ``array<MARKER>`` in the order in which the phases find them; empty for null text.

    Each phase is a projection of its own, so that its matches are found once; there is no shuffle.
    """
    lex = lexicon or bundled()
    # most texts hold neither sign: all phases see an empty text then
    some = F.col(text).contains("&#167;" if html else "§") | F.col(text).contains("Art")
    cur = df.withColumn("__law_t", F.when(F.coalesce(some, F.lit(False)), guarded(F.col(text))).otherwise(""))
    order = phases(lex, html)
    for i, p in enumerate(order):

        def marker(m: Column) -> Column:  # used at once, in this round
            return F.struct(F.lit(i).alias("phase"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), _references(p, m, lex).cast(REF).alias("refs"), m["gap"].alias("gap"))

        cur = cur.withColumn(f"__law_r{i}", matches(F.col("__law_t"), p.pattern, p.groups))
        cur = fixed(cur, f"__law_m{i}", F.transform(f"__law_r{i}", marker)).drop(f"__law_r{i}")
        if i + 1 < len(order):
            use = (lambda m: F.size(m["refs"]) > 0) if p.name == "multi" else None
            cur = fixed(cur, "__law_t", masked(F.col("__law_t"), F.col(f"__law_m{i}"), use))
    plain = lambda m: F.struct(*[m[c].alias(c) for c in ("phase", "start", "end", "text", "refs")])
    found = F.filter(F.concat(*[F.transform(f"__law_m{i}", plain) for i in range(len(order))]), lambda m: F.size(m["refs"]) > 0)
    return fixed(cur, out, found.cast(f"array<{MARKER}>")).drop("__law_t", *[f"__law_m{i}" for i in range(len(order))])


def with_context_markers(df: DataFrame, book: str, text: str = "text", out: str = "markers") -> DataFrame:
    """Markers in texts of a known book: ranges of sections (both ``bis`` and ``und``), annexes and single sections.

    The entity of the section sign is replaced first, and offsets count in the text after that.
    """
    name = F.lit(book)
    patterns = [
        (r"§§ (?<a>[0-9]+) (?:bis|und) (?<b>[0-9]+)", ("a", "b")),
        (r"Anlage (?<a>[0-9]+)", ("a",)),
        (r"§ (?<a>[0-9]+)(?:\s(?:Abs\.|Absatz)\s[0-9]+)?(?:\sSatz\s[0-9]+)?", ("a",)),
    ]

    def number(x: Column) -> Column:
        return x.try_cast("long")

    def refs(i: int, m: Column) -> Column:
        g = m["groups"]
        if i == 0:
            a, b = number(g[0]), number(g[1])
            each = F.transform(F.sequence(a, b), lambda n: _ref(name, n.cast("string")))
            ends = F.array(_ref(name, a.cast("string")), _ref(name, b.cast("string")))
            return F.when((a <= b) & (b - a < MAX_RANGE), each).when(a <= b, ends).otherwise(F.array().cast(REF))
        if i == 1:
            return F.array(_ref(name, F.concat(F.lit("anlage-"), number(g[0]).cast("string"))))
        return F.array(_ref(name, g[0]))

    cur = df.withColumn("__law_t", F.coalesce(F.replace(guarded(F.col(text)), F.lit("&#167;"), F.lit("§")), F.lit("")))
    for i, (pattern, groups) in enumerate(patterns):
        cur = fixed(cur, f"__law_r{i}", matches(F.col("__law_t"), pattern, groups))
        if i + 1 < len(patterns):
            cur = cur.withColumn("__law_t", masked(F.col("__law_t"), F.col(f"__law_r{i}")))

    def marker(i: int):
        return lambda m: F.struct(F.lit(i).alias("phase"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), refs(i, m).cast(REF).alias("refs"))

    made = [F.transform(f"__law_r{i}", marker(i)) for i in range(len(patterns))]
    return fixed(cur, out, F.concat(*made).cast(f"array<{MARKER}>")).drop("__law_t", *[f"__law_r{i}" for i in range(len(patterns))])


def split_spans(marker: Column) -> Column:
    """A span for each reference of a multi-section marker: parts that begin behind a section sign, comma or semicolon.

    References that begin no part share the one before them; with fewer than two parts all have the marker's span.
    """
    text, refs = marker["text"], marker["refs"]
    whole = F.struct(F.lit(0).alias("a"), F.length(text).alias("b"))

    def locate(acc: Column, r: Column) -> Column:
        rest = F.substr(text, acc["at"] + 1)
        hit = F.regexp_instr(rest, F.concat(F.lit("(?<![0-9])"), r["section"], F.lit("(?![0-9])")))
        pos = acc["at"] + hit - 1
        before = F.rtrim(F.substr(text, F.lit(1), pos))
        edge = (pos == 0) | before.rlike("[§,;]$")
        last = F.when((hit > 0) & edge, pos).otherwise(acc["last"])
        return F.struct(F.when(hit > 0, pos + F.length(r["section"])).otherwise(acc["at"]).alias("at"), last.alias("last"), F.concat(acc["out"], F.array(last)).alias("out"))

    def spans(starts: Column) -> Column:
        edges = F.array_distinct(F.filter(starts, lambda s: s.isNotNull()))  # they grow

        def one(_: Column, i: Column) -> Column:
            begin = F.coalesce(F.get(starts, i), edges[0])
            nxt = F.array_min(F.filter(edges, lambda s: s > begin))
            end = F.when(nxt.isNull(), F.length(text)).otherwise(F.length(F.regexp_replace(F.substr(text, F.lit(1), nxt), "[ ,;]+$", "")))
            return F.struct(F.when(begin == edges[0], 0).otherwise(begin).alias("a"), end.alias("b"))

        return F.when(F.size(edges) >= 2, F.transform(refs, one)).otherwise(F.transform(refs, lambda _: whole))

    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("out"))
    found = F.when(F.size(refs) > 1, F.aggregate(refs, zero, locate)["out"]).otherwise(F.array(F.lit(None).cast("int")))
    return F.transform(let(found, spans), lambda s: span(marker["start"] + s["a"], marker["start"] + s["b"], F.substr(text, s["a"] + 1, s["b"] - s["a"])))


def unit_of(book: Column, text: Column, lexicon: LawLexicon) -> Column:
    """The code's own unit, or else what the text says."""
    guess = F.when(text.startswith("Art") | text.startswith("art"), "article").otherwise("paragraph")
    # sets are hashed; a map of literals becomes a branch for each code, and each would make the name lower again
    codes: dict[str, list[str]] = {}
    for code, unit in sorted(lexicon.units.items()):
        codes.setdefault(unit, []).append(code)
    own = [F.when(F.lower(book).isin(*names), unit) for unit, names in codes.items()]
    return F.coalesce(*own, guess)


def law_citations(markers: Column, lexicon: LawLexicon | None = None, multi_ref: str = "split") -> Column:
    """``array<CITATION>``: one for each reference; ``multi_ref`` is ``split`` (spans of their parts) or ``collapse`` (all the marker's)."""
    lex = lexicon or bundled()
    if multi_ref not in ("split", "collapse"):
        raise ValueError("multi_ref is split or collapse")

    def one(m: Column, s: Column, r: Column) -> Column:
        unit = unit_of(r["book"], m["text"], lex)
        return citation(id=citation_id(s), type=F.lit("law"), span=s, unit=unit, delimiter=F.when(unit == "article", "Art.").otherwise("§"), book=r["book"], number=r["section"])

    def each(m: Column) -> Column:
        if multi_ref == "collapse":
            return let(span(m["start"], m["end"], m["text"]), lambda s: F.transform(m["refs"], lambda r: one(m, s, r)))
        return let(split_spans(m), lambda ss: F.transform(m["refs"], lambda r, i: one(m, F.get(ss, i), r)))

    return F.flatten(F.transform(markers, each)).cast(f"array<{CITATION}>")
