"""Law codes, register codes, courts and reporters, and the patterns made of them on the driver."""

from __future__ import annotations

import csv
import logging
import os
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundstelle.functions.dialect import literal, trie

DATA = Path(__file__).resolve().parent.parent / "data"
log = logging.getLogger(__name__)


class CitationError(ValueError):
    """Arguments from which no pattern can be made."""


class AmbiguousReferenceError(CitationError):
    """A reference that stands for several targets."""


BASE_CODES = tuple(sorted("AsylG BGB GG VwGO GkG stbstg lbo ZPO LVwG BauGB BauNVO ZWStS SbStG StPO TKG SG SGG".split())) + ("AGVwGO SH", "SGB X")
GENERIC_BOOK = r"[A-ZÄÜÖ][-ÄÜÖäüöA-Za-z]{0,20}[VGOB](?:\s[XIV]{1,5})?"
UNITS = ("article", "paragraph")
OFF = frozenset(("", "0", "False", "false"))


def _rows(path: Path) -> list[dict[str, str]]:
    with open(path, encoding="utf-8", newline="") as f:
        return list(csv.DictReader(f))


@dataclass(frozen=True)
class LawLexicon:
    """Codes in order of precedence and their units by lower-cased code; immutable, so hints and codes always agree."""

    codes: tuple[str, ...]
    units: dict[str, str] = field(default_factory=dict)
    precise: bool = True

    def unit_hint(self, code: str | None) -> str | None:
        return self.units.get(code.lower()) if code else None

    def with_codes(self, codes: list[str] | None) -> LawLexicon:
        return LawLexicon(tuple(codes) if codes else BASE_CODES, self.units, self.precise)

    def book_pattern(self, optional: bool = False, group_name: bool = False) -> str:
        """The longest code that fits, or else what looks like the name of a code."""
        if optional or group_name:
            raise ValueError("the book is neither optional nor a named group")
        if not self.codes:
            raise CitationError("there are no law codes")
        if not self.precise:
            return GENERIC_BOOK
        longest = sorted(self.codes, key=len, reverse=True)
        return f"(?:{trie([[literal(c) for c in code] for code in longest])}|{GENERIC_BOOK})"


def merge_codes(file_codes: list[str], base: tuple[str, ...] = BASE_CODES) -> tuple[str, ...]:
    """The base codes and those of a file that they lack; case doesn't count, the first stays."""
    return tuple({c.lower(): c for c in reversed([*base, *file_codes])}[k] for k in dict.fromkeys(c.lower() for c in [*base, *file_codes]))


def load_law_lexicon(path: str | os.PathLike | None = None, precise: bool | None = None) -> LawLexicon:
    """Codes and units of a table ``length,unit,code`` or of lines ``code`` or ``code<TAB>unit``; without it the bundled table.

    ``CITATIONS_PRECISE_BOOKS`` set to 0, false or nothing switches to the generic pattern, as ``precise=False`` does.
    A missing file leaves the base codes.
    """
    if precise is None:
        precise = os.environ.get("CITATIONS_PRECISE_BOOKS", "1") not in OFF
    if not precise:
        return LawLexicon(BASE_CODES, {}, False)
    p = Path(path) if path else DATA / "law_codes.csv"
    if not p.exists():
        log.warning("no law codes at %s", p)
        return LawLexicon(BASE_CODES)
    if p.suffix == ".csv":
        pairs = [(r["code"], r["unit"]) for r in _rows(p)]
    else:
        pairs = [(a.strip(), b.strip().lower()) for a, _, b in (line.rstrip("\n").partition("\t") for line in open(p, encoding="utf-8")) if a.strip()]
    return LawLexicon(merge_codes([c for c, _ in pairs]), {c.lower(): u for c, u in pairs if u in UNITS})


@lru_cache(maxsize=4)
def bundled(precise: bool = True) -> LawLexicon:
    return load_law_lexicon(precise=precise)


def law_codes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(code, unit)`` of a tab-separated or the bundled table; units other than article and paragraph are null."""
    if path:
        raw = spark.read.csv(path, sep="\t", schema="code string, unit string", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    else:
        raw = spark.read.csv(f"file://{DATA}/law_codes.csv", header=True, schema="length int, unit string, code string").select("code", "unit")
    unit = F.lower("unit")
    return raw.where(F.trim("code") != "").select("code", F.when(unit.isin(*UNITS), unit).alias("unit"))


def register_codes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The distinct register codes: the first column of a CSV table, without a remark in brackets."""
    raw = spark.read.csv(path, schema="code string") if path else spark.read.csv(f"file://{DATA}/register_codes.csv", header=True, schema="code string")
    return raw.select(F.regexp_replace("code", r"\s[(].*?[)]", "").alias("code")).where("code is not null").distinct()


@lru_cache(maxsize=1)
def register_code_set() -> frozenset[str]:
    return frozenset(r["code"] for r in _rows(DATA / "register_codes.csv"))


def _atoms(name: str, escape: bool) -> list[str]:
    if escape:
        return [literal(c) for c in name]
    return [c for c in name if c not in "()"]  # a dot is any character, brackets only group


@lru_cache(maxsize=2)
def court_pattern(escape: bool = False) -> str:
    """Group ``court`` and the delimiter behind it, from federal courts and courts with a region or city on either side."""
    kinds: dict[str, list[str]] = {}
    for r in sorted(_rows(DATA / "courts.csv"), key=lambda r: int(r["rank"])):
        kinds.setdefault(r["kind"], []).append(r["name"])
    options = list(kinds["federal"])
    for courts, places in (("regional court", "region"), ("city court", "city")):
        for court in kinds[courts]:
            for place in kinds[places]:
                options += (f"{court} {place}", f"{place} {court}")
    atoms = [a for a in (_atoms(o, escape) for o in options) if a]
    heads = sorted({a[0] for a in atoms})
    ahead = f"(?=[{''.join(heads)}])" if all(h.isalpha() for h in heads) else ""
    return f"{ahead}(?<court>{trie(atoms)})[\\s.;,:)]"


REPORTERS = (
    "AuAS BAGE BB BFHE BGHR BGHSt BGHZ BPatGE BSGE BVerfGE BVerwGE BayVBl DAR DB DVBl DÖV EFG FamRZ GA GRUR GRUR-RR GrS HFR InfAuslR JR JZ LKRZ MDR "
    "NJW NJW-RR NStZ NStZ-RR NVwZ NVwZ-RR NZA NZA-RR NZBau NZG NZM NZS NZV NZWiSt NordÖR RGSt RGZ RiA SozR StV VRS VersR WM ZIP ZMR ZUM ZfA wistra BFH/NV"
).split()
REPORTER_COURT = {f"{court}{part}": court for court, parts in (("BAG", "E"), ("BFH", "E"), ("BGH", "R St Z"), ("BPatG", "E"), ("BSG", "E"), ("BVerfG", "E"), ("BVerwG", "E"), ("RG", "St Z")) for part in parts.split()}


@lru_cache(maxsize=1)
def reporter_pattern() -> str:
    names = trie([[literal(c) for c in r] for r in sorted(REPORTERS, key=len, reverse=True)])
    heads = "".join(sorted({r[0] for r in ("BStBl", *REPORTERS)}))  # a look at one sign spares the way through all names at most places
    return rf"(?=[{heads}])(?<reporter>BStBl\s?I{{1,2}}|{names})\s+(?<volume>[0-9]{{1,4}}),\s*(?<page>[0-9]+)(?:,\s*[0-9]+)?"
