"""From documents to citations and relations: engines, merge, short forms and relations, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundstelle.functions.dialect import fixed
from fundstelle.operators.case import case_citations, with_case_markers
from fundstelle.operators.law import law_citations, with_context_markers, with_law_markers
from fundstelle.operators.merge import resolve_overlaps
from fundstelle.operators.normalize import with_normalized
from fundstelle.operators.resolve import relations, resolve_case, resolve_law
from fundstelle.schema import CITATION, MARKER
from fundstelle.sources.lexicon import LawLexicon

#: An engine adds a column ``out`` of ``array<CITATION>`` to a table with a column ``text``.
Engine = Callable[[DataFrame, str, str], DataFrame]


def law_engine(lexicon: LawLexicon | None = None, multi_ref: str = "split") -> Engine:
    def run(df: DataFrame, text: str, out: str) -> DataFrame:
        return fixed(with_law_markers(df, text, "__m", lexicon), out, law_citations(F.col("__m"), lexicon, multi_ref)).drop("__m")

    return run


def case_engine(reporter_fields: bool = False, escape_courts: bool = False) -> Engine:
    def run(df: DataFrame, text: str, out: str) -> DataFrame:
        return fixed(with_case_markers(df, text, "__m", escape_courts), out, case_citations(F.col("__m"), reporter_fields)).drop("__m")

    return run


def default_engines(**options) -> list[Engine]:
    return [law_engine(**{k: v for k, v in options.items() if k in ("lexicon", "multi_ref")}), case_engine(**{k: v for k, v in options.items() if k in ("reporter_fields", "escape_courts")})]


def extract(docs: DataFrame, engines: Sequence[Engine] | None = None, normalize: bool = True, **options) -> DataFrame:
    """Add ``citations`` and ``relations`` to documents ``(doc_id, raw[, format])`` or, with ``normalize=False``, ``(doc_id, text)``.

    The engines see the plain text. Only per-row expressions are used, so it runs on streams too.
    """
    cur = with_normalized(docs) if normalize else docs
    names = []
    for i, engine in enumerate(engines if engines is not None else default_engines(**options)):
        cur = engine(cur, "text", f"__e{i}")
        names.append(f"__e{i}")
    both = F.concat(*names) if names else F.array()
    cur = cur.withColumn("__all", both.cast(f"array<{CITATION}>")).drop(*names)
    cur = fixed(cur, "__one", resolve_overlaps(F.col("__all"))).drop("__all")
    cur = fixed(cur, "__law", resolve_law(F.col("__one"))).drop("__one")
    cur = fixed(cur, "citations", resolve_case(F.col("__law"))).drop("__law")
    return fixed(cur, "relations", relations(F.col("citations"), F.col("text")))


def citation_rows(extracted: DataFrame) -> DataFrame:
    """``(doc_id, ord, …fields of a citation)``."""
    return extracted.select("doc_id", F.posexplode("citations").alias("ord", "c")).select("doc_id", "ord", "c.*")


def relation_rows(extracted: DataFrame) -> DataFrame:
    return extracted.select("doc_id", F.explode("relations").alias("r")).select("doc_id", "r.*")


def extract_markers(docs: DataFrame, law: bool = True, case: bool = True, context: str | None = None, html: bool = False) -> DataFrame:
    """The older interface: add ``markers`` (law phases first, then cases), found in the text without ``[ref=…]`` tags.

    ``context`` is the book that all sections are of. Both kinds see the same text; nothing is merged or resolved.
    """
    from fundstelle.operators.normalize import remove_markers

    cur = docs.withColumn("text", remove_markers(F.col("text")))
    names = []
    if law:
        cur = with_context_markers(cur, context, "text", "__l") if context else with_law_markers(cur, "text", "__l", html=html)
        names.append("__l")
    if case:
        cur = with_case_markers(cur, "text", "__c")
        names.append("__c")
    return fixed(cur, "markers", F.concat(*names).cast(f"array<{MARKER}>") if names else F.array().cast(f"array<{MARKER}>")).drop(*names)
