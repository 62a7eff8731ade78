"""Case references: reporters, file numbers, and the courts around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundstelle.functions.dialect import FLAGS, fixed, guarded, matches, slice_text
from fundstelle.schema import CITATION, MARKER, citation, citation_id, span
from fundstelle.sources.lexicon import court_pattern, reporter_pattern

_REGISTER = "(?:" + "|".join(sorted("S RH R KH K GS C BH B AR".split())) + ")"
#: With a dot, more digits and one more dot behind it make an IP address or a date of what looks like a number and a year.
FILE_NUMBER = rf"(?:[BLS]\s)?(?:[0-9]{{1,2}}[a-z]?|[IVX]+)\s(?<code>[A-Z][a-zA-Z]{{0,4}})(?:\s\([A-Za-z]{{1,6}}\))?(?:\s[A-Za-z]{{1,6}})?\s[0-9]{{1,6}}(?:/[0-9]{{2}}|\.[0-9]{{2}}(?![0-9]*\.[0-9]))(?:\s{_REGISTER})?"
_SUBJECTS = "(?:A[LSY]?|B[KL]|EG|K[AGRS]|LW|P|R[ES]?|S[BFO]|U|ÜG|V[GHJKS]?)"
SOCIAL = rf"^([BLS])\s[0-9]{{1,2}}\s{_SUBJECTS}\s[0-9]{{1,6}}/[0-9]{{2}}"
SOCIAL_COURT = dict(S="SG", L="LSG", B="Bundessozialgericht")
#: Currencies, units and abbreviations that look like register codes.
NOT_CODES = ("Abs", "DM", "EUR", "GB", "GHz", "KB", "KHz", "MB", "MHz", "Nr", "Rn", "TB")
WINDOWS = (100, 200, 500)
_CASE_REF = "struct<book:string,section:string,court:string,file_number:string>"


def search_court(text: Column, start: Column, end: Column, escape: bool = False) -> Column:
    """The leftmost court within 100, 200 or 500 characters of a span, whichever has one first."""

    def near(reach: int) -> Column:
        around = slice_text(text, F.greatest(F.lit(0), start - reach), F.least(F.length(text), end + reach))
        return F.nullif(F.regexp_extract(around, FLAGS + court_pattern(escape), 1), F.lit(""))

    return F.coalesce(*[near(r) for r in WINDOWS])


def infer_court(file_number: Column, searched: Column) -> Column:
    """Social courts show in their file numbers; a found court that names that instance is preferred."""
    kind = F.regexp_extract(file_number, FLAGS + SOCIAL, 1)
    instance = F.when(kind == "B", SOCIAL_COURT["B"]).when(kind == "L", SOCIAL_COURT["L"]).when(kind == "S", SOCIAL_COURT["S"])
    return F.when(searched.contains(instance), searched).otherwise(F.coalesce(instance, searched))


def _marker(phase: int, m: Column, court: Column, number: Column) -> Column:
    none = F.lit(None).cast("string")
    ref = F.struct(none.alias("book"), none.alias("section"), court.alias("court"), number.alias("file_number")).cast(_CASE_REF)
    return F.struct(F.lit(phase).alias("phase"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.array(ref).alias("refs"))


def with_case_markers(df: DataFrame, text: str = "text", out: str = "markers", escape_courts: bool = False) -> DataFrame:
    """Add ``out``: ``array<MARKER>``, reporters first and then file numbers that start outside them; empty for null text."""
    shape = F.col(text).rlike(r"[0-9]{1,4},|[0-9][/.][0-9]{2}")
    cur = df.withColumn("__case_t", F.when(F.coalesce(shape, F.lit(False)), guarded(F.col(text))).otherwise(""))
    t = F.col("__case_t")
    cur = fixed(fixed(cur, "__case_r", matches(t, reporter_pattern(), ("reporter", "volume", "page"))), "__case_f", matches(t, FILE_NUMBER, ("code",)))
    inside = lambda m: F.exists("__case_r", lambda r: (r["start"] <= m["start"]) & (m["start"] < r["end"]))
    cur = fixed(cur, "__case_f", F.filter("__case_f", lambda m: ~m["groups"][0].isin(*NOT_CODES) & ~inside(m)))
    # the search is by far the dearest step: one value for each file number, in a column of its own
    cur = fixed(cur, "__case_c", F.transform("__case_f", lambda m: search_court(t, m["start"], m["end"], escape_courts)))
    reporters = F.transform("__case_r", lambda m: _marker(0, m, F.lit(""), F.concat(m["groups"][0], F.lit(" "), m["groups"][1], F.lit(", "), m["groups"][2])))
    numbers = F.transform("__case_f", lambda m, i: _marker(1, m, F.coalesce(infer_court(m["text"], F.get("__case_c", i)), F.lit("")), m["text"]))
    return fixed(cur, out, F.concat(reporters, numbers).cast(f"array<{MARKER}>")).drop("__case_t", "__case_r", "__case_f", "__case_c")


def case_citations(markers: Column, reporter_fields: bool = False) -> Column:
    """``array<CITATION>``; empty fields are null. With ``reporter_fields``, reporter, volume and page of reporters are filled in."""

    def one(m: Column) -> Column:
        r, s = m["refs"][0], span(m["start"], m["end"], m["text"])
        extra = {}
        if reporter_fields:
            parts = F.regexp_extract(r["file_number"], "^(.+) ([0-9]+), ([0-9]+)$", 1), F.regexp_extract(r["file_number"], "^(.+) ([0-9]+), ([0-9]+)$", 2), F.regexp_extract(r["file_number"], "^(.+) ([0-9]+), ([0-9]+)$", 3)
            extra = {k: F.when(m["phase"] == 0, F.nullif(v, F.lit(""))) for k, v in zip(("reporter", "reporter_volume", "reporter_page"), parts)}
        return citation(id=citation_id(s), type=F.lit("case"), span=s, court=F.nullif(r["court"], F.lit("")), file_number=F.nullif(r["file_number"], F.lit("")), **extra)

    return F.transform(markers, one).cast(f"array<{CITATION}>")
