"""Sections of a text by its headings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import let, strip

# The headings and the names of their sections.
HEADINGS = (
    ("abstract", r"abstract"),
    ("introduction", r"introduction"),
    ("methods", r"(?:materials?\s+and\s+)?methods?"),
    ("results", r"results?"),
    ("discussion", r"discussion"),
    ("conclusion", r"conclusions?"),
    ("acknowledgements", r"acknowledge?ments?"),
    ("references", r"references"),
    ("appendix", r"appendix"),
    ("supplementary", r"supplementary"),
)
_ANY = r"(?i)\b(?:" + "|".join(p for _, p in HEADINGS) + r")\b"
_MARK = "\x01"


def _name(piece: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(HEADINGS):
        out = F.when(piece.rlike(rf"(?i)^{pattern}\b"), name).otherwise(out)
    return out


def parse(text: Column) -> Column:
    """Sections of a text as an array of (name, body), in the order of the headings' names.

    A heading starts the text or a line, or stands behind the end of a sentence. Its
    section begins with the next line end and goes to the next heading; where no line
    end follows in the whole text it begins with the heading. Blank sections do not
    count, and of several with one name the last does. Null gives an empty array; the
    character U+0001 counts as a blank. One expression: headings are marked, marks that
    stand elsewhere taken out, and the text cut at the rest.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), _MARK, " ")
    marked = F.regexp_replace(clean, _ANY, f"{_MARK}$0")
    marked = F.regexp_replace(marked, rf"(?s)(?<=.)(?<![\n\r])(?<!\. )(?<!\.\n){_MARK}", "")
    line = F.lit("\n")

    def entries(pieces: Column) -> Column:
        last = F.array_max(F.transform(pieces, lambda p, k: F.when(F.contains(p, line), k).otherwise(-1)))
        body = lambda p, k: F.when(F.contains(p, line), F.substr(p, F.instr(p, line))).when(k > last, p).otherwise("")
        made = F.transform(pieces, lambda p, k: F.struct(_name(p).alias("name"), strip(body(p, k)).alias("body")))
        headed = F.filter(made, lambda e: e["name"].isNotNull() & (e["body"] != ""))
        return let(headed, lambda h: F.array_compact(F.array(*[_last(h, n) for n, _ in HEADINGS])))

    return let(F.split(marked, _MARK), entries)


def _last(entries: Column, name: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["name"] == name), F.lit(-1))
