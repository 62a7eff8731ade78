"""A derived corpus: sentences with references behind real texts, and what must be found in them.

A template is a list of SQL expressions whose values make up the sentence, and spans of these parts. The same SQL
runs on Spark, where the sentences are searched, and on DuckDB, where the expected rows come of the parts' lengths
alone; no pattern is involved there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def num(k: str) -> str:
    return f"cast({k} as string)"


@dataclass(frozen=True)
class Cite:
    """Parts ``first`` to ``last`` and the fields that they have, as SQL."""

    first: int
    last: int
    fields: dict[str, str]


class Template:
    """``{n}``, ``{m}``, ``{a}`` in the parts are numbers that differ by document."""

    NUMBERS = {"n": "doc_id % 900 + 1", "m": "doc_id % 700 + 1000", "m1": "doc_id % 700 + 1003", "n1": "doc_id % 900 + 2", "n2": "doc_id % 900 + 3", "n3": "doc_id % 900 + 4", "a": "doc_id % 9 + 1", "y": "doc_id % 90 + 10"}

    def __init__(self, parts: list[str], cites: list[Cite] = (), noise: bool = True):  # type: ignore[assignment]
        self.parts = [self.sql(p) for p in parts]
        self.cites = list(cites)
        self.noise = noise

    @classmethod
    def sql(cls, part: str) -> str:
        """A text with placeholders as an SQL expression."""
        out, rest = [], part
        while "{" in rest:
            head, _, tail = rest.partition("{")
            key, _, rest = tail.partition("}")
            if head:
                out.append(lit(head))
            out.append(num(cls.NUMBERS[key]))
        if rest or not out:
            out.append(lit(rest))
        return out[0] if len(out) == 1 else f"concat({', '.join(out)})"

    def joined(self, parts: list[str]) -> str:
        return "''" if not parts else parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"

    @property
    def lead(self) -> list[str]:
        return ["coalesce(text, '')", "' '"] if self.noise else []

    @property
    def text(self) -> str:
        return self.joined(self.lead + self.parts)

    def docs(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """``(doc_id, text)``, one for each row of documents."""
        return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", f"{self.text} as text")

    def start(self, c: Cite) -> str:
        return f"length({self.joined(self.lead + self.parts[: c.first])})"

    def span(self, c: Cite) -> str:
        return self.joined(self.parts[c.first : c.last + 1])

    def expected(self, *fields: str, where: bool = True) -> str:
        """SQL for ``(doc_id, start_pos, end_pos, span_text, …fields)``."""
        rows = []
        for c in self.cites:
            place = f"cast({self.start(c)} as bigint) as start_pos, cast({self.start(c)} + length({self.span(c)}) as bigint) as end_pos, {self.span(c)} as span_text" if where else ""
            cols = ", ".join(filter(None, [place, *[f"{c.fields.get(f, 'cast(null as varchar)')} as {f}" for f in fields]]))
            rows.append(f"select doc_id, {cols} from documents")
        return " union all ".join(rows)


def law(first: int, last: int, book: str, number: str, unit: str = "paragraph") -> Cite:
    return Cite(first, last, {"type": "'law'", "book": lit(book), "number": Template.sql(number), "unit": lit(unit)})


def case(first: int, last: int, court: str | None, number: str) -> Cite:
    return Cite(first, last, {"type": "'case'", "court": lit(court) if court else "cast(null as varchar)", "file_number": Template.sql(number)})


LAW = {
    "law_single": Template(["Nach ", "§ {n} BGB", " gilt dies."], [law(1, 1, "bgb", "{n}")]),
    "law_any_content": Template(["Nach ", "§ {n} Abs. {a} Satz 2 VwGO", " ist dies so."], [law(1, 1, "vwgo", "{n}")]),
    "law_long_clause": Template(["Nach ", "§ {n} " + "Abs. {a} Satz 2, " * 80 + "Nr. {m} BGB", " gilt dies."], [law(1, 1, "bgb", "{n}")]),
    "law_paragraph_alternative": Template(["Siehe ", "§ {n} Abs. {a} Alt. 1 VwGO", ", der"], [law(1, 1, "vwgo", "{n}")]),
    "law_multi_sections": Template(["Laut ", "§§ {n}", ", ", "{m} BGB", " gilt"], [law(1, 1, "bgb", "{n}"), law(3, 3, "bgb", "{m}")]),
    "law_multi_books": Template(["Die ", "§ {n} VwGO", " i.V.m. ", "§§ {m} Nr. 11", ", ", "{m1} ZPO", "."], [law(1, 1, "vwgo", "{n}"), law(3, 3, "zpo", "{m}"), law(5, 5, "zpo", "{m1}")]),
    "law_full_name": Template(["nach ", "§ {n} der Zivilprozessordnung", " kann und ", "§ {m} des Verwaltungsverfahrensgesetzes", " ist"], [law(1, 1, "zivilprozessordnung", "{n}"), law(3, 3, "verwaltungsverfahrensgesetz", "{m}")]),
    "law_article_single": Template(["Nach ", "Art. {n} Abs. {a} GG", " ist dies so, ", "Artikel {m} GG", "."], [law(1, 1, "gg", "{n}", "article"), law(3, 3, "gg", "{m}", "article")]),
    "law_end_of_text": Template(["Nach ", "§ {n} BGB", ", § {m} ZPO"], [law(1, 1, "bgb", "{n}")]),
    "law_no_break_space": Template(["nach ", "§ {n} Abs. 1 VwGO", " und"], [law(1, 1, "vwgo", "{n}")]),
    "law_unit_hint": Template(["Nach ", "§ {n} GG", " und ", "Art. {m} BGB", " gilt"], [law(1, 1, "gg", "{n}", "article"), law(3, 3, "bgb", "{m}")]),
}
CASE = {
    "case_file_number": Template(["x, ", "{a} C {n}.{y}", " und 12 EUR 100/20 sowie ", "VIII ZR {m}/{y}", " y"], [case(1, 1, None, "{a} C {n}.{y}"), case(3, 3, None, "VIII ZR {m}/{y}")]),
    "case_reporter": Template(["Vgl. ", "BGHZ {n}, {m}", " sowie ", "NJW-RR 2013, {n}, {m}", " so"], [case(1, 1, None, "BGHZ {n}, {m}"), case(3, 3, None, "NJW-RR 2013, {n}")]),
    "case_court_window": Template(["BGH, Urteil vom 20.02.2013 - ", "VIII ZR {m}/{y}", " - entschied"], [case(1, 1, "BGH", "VIII ZR {m}/{y}")]),
    "case_social_court": Template(["und ", "B {a} KA {n}/{y} R", " x"], [case(1, 1, "Bundessozialgericht", "B {a} KA {n}/{y} R")]),
}
RELATED = Template(["so ", "§ {n} BGB", " ", "i.V.m.", " ", "§ {m} BGB", " regeln (", "vgl.", " ", "Art. {a} GG", ") x"], [law(1, 1, "bgb", "{n}"), law(5, 5, "bgb", "{m}"), law(9, 9, "gg", "{a}", "article")])
MIXED = Template(
    ["Nach ", "§ {n} Abs. {a} BGB", " ", "i.V.m.", " ", "§ {m} ZPO", " hat der BGH, Urteil vom 20.02.2013 - ", "VIII ZR {n}/{y}", " - erkannt, ", "Art. {a} GG", ", ", "BGHZ {n}, {m}", " folgt."],
    [law(1, 1, "bgb", "{n}"), law(5, 5, "zpo", "{m}"), case(7, 7, "BGH", "VIII ZR {n}/{y}"), law(9, 9, "gg", "{a}", "article"), case(11, 11, None, "BGHZ {n}, {m}")],
)
