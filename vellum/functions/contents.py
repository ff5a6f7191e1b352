"""Tables of contents, headings of chapters and title pages, found in the lines of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import compact, let, norm_sp
from vellum.functions.titles import one_line

# Forms of entries and headings, and words of entries.
ENTRY = r"(\.{2,}\s*[0-9]+$)|(?i)(^(chapter\s+)?[0-9]+[.:]?\s+\S)"
ENTRY_WORDS = "introduction|references|acknowledg|contributors"
CHAPTER = r"(?i)^(chapter|part)\s+[0-9ivxlcdm]+[:.\s-]+\S"
NUMBERED = r"^[0-9]{1,2}\s+[A-Z][A-Za-z].{8,}$"
EDITOR = r"\b(edited by|editors?|contributors?)\b"
HANDBOOK = r"\b(handbook|companion|oxford handbooks|cambridge handbooks)\b"
YEAR = r"\b(?:19|20)[0-9]{2}\b"
TITLE_WORDS_LEFT_OUT = ("the", "of", "and", "a", "an", "to", "in", "for")


def lines(text: Column) -> Column:
    """The lines of a text that hold something, white space in them as one space."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r"), one_line), lambda x: x != "")


def table_of_contents(ls: Column, most: int = 25, reach: int = 90) -> Column:
    """Whether there is a table of contents, its line (from 0) and its distinct entries within ``reach`` lines.

    It begins at the first line that is or begins with ``contents`` and ends before a line ``references`` or ``index``.
    """
    head = F.filter(
        F.transform(ls, lambda x, i: F.when(F.lower(x).isin("contents", "table of contents") | F.lower(x).startswith("contents "), i)), lambda i: i.isNotNull()
    )

    def entries(start: Column) -> Column:
        below = F.slice(ls, start + 2, F.lit(reach - 1))
        ends = F.filter(F.transform(below, lambda x, i: F.when(F.lower(x).isin("references", "index"), i)), lambda i: i.isNotNull())
        inside = F.slice(below, F.lit(1), F.coalesce(F.get(ends, F.lit(0)), F.lit(reach)))
        good = F.filter(inside, lambda x: F.length(x).between(4, 180) & (x.rlike(ENTRY) | F.lower(x).rlike(ENTRY_WORDS)))
        return F.slice(F.array_distinct(F.transform(good, lambda x: F.lower(x))), 1, most)

    found = lambda start: F.struct(start.isNotNull().alias("found"), start.alias("line"), F.when(start.isNotNull(), entries(start)).otherwise(F.array().cast("array<string>")).alias("entries"))
    return let(F.get(head, F.lit(0)), found)


def chapters(ls: Column, most: int = 30) -> Column:
    """The first headings of chapters and parts, with their lines (from 0)."""
    good = lambda x: (F.length(x) <= 160) & (x.rlike(CHAPTER) | x.rlike(NUMBERED))
    return F.slice(F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("line"), x.alias("heading"))), lambda x: good(x["heading"])), 1, most)


def title_page(ls: Column, title: Column, year: Column, doi: Column, has_isbn: Column) -> Column:
    """How well the first 250 lines confirm a title: a score (12 + 8 + 6 + 4 + 4 + 2), its reasons and what bars it."""

    def confirmed(key: Column, page: Column, whole: Column) -> Column:
        words = F.filter(F.split(key, " "), lambda w: (F.length(w) >= 4) & ~w.isin(*TITLE_WORDS_LEFT_OUT))
        hits = F.size(F.filter(words, lambda w: F.contains(whole, w)))
        in_line = F.exists(page, lambda x: let(norm_sp(x), lambda n: (n != "") & (F.contains(n, key) | F.contains(key, n))))
        enough = hits >= F.greatest(F.lit(2), F.floor(F.size(words) * 6 / 10))
        return F.when(key == "", F.lit(None)).when(in_line, "line").when(F.contains(whole, F.replace(key, F.lit(" "))), "compact").when(enough, "fragments")

    def judged(key: Column, whole: Column, low: Column, how: Column) -> Column:
        blank = lambda x: F.coalesce(x, F.lit("")) == ""
        tests = (
            (12, "title", how.isNotNull()),
            (8, "editor", low.rlike(EDITOR) | F.contains(low, F.lit("editor"))),
            (6, "handbook", low.rlike(HANDBOOK) | whole.rlike("handbook|companion")),
            (4, "isbn", F.contains(low, F.lit("isbn")) | has_isbn),
            (4, "year", ~blank(year) & low.rlike(YEAR)),
            (2, "doi", ~blank(doi)),
        )
        return F.struct(
            sum((F.when(t, n).otherwise(0) for n, _, t in tests), F.lit(0)).alias("score"),
            F.array_compact(F.array(*[F.when(t, name) for _, name, t in tests])).alias("reasons"),
            how.alias("how"),
            F.when(key == "", "missing_title").when(how.isNull(), "title_not_confirmed").alias("blocker"),
        )

    of_whole = lambda key, page, low, whole: let(confirmed(key, page, whole), lambda how: judged(key, whole, low, how))
    of_low = lambda key, page, low: let(compact(F.array_join(page, "\n")), lambda whole: of_whole(key, page, low, whole))
    of_page = lambda key, page: let(F.lower(F.array_join(F.slice(page, 1, 200), "\n")), lambda low: of_low(key, page, low))
    return let(norm_sp(F.coalesce(title, F.lit(""))), lambda key: let(F.slice(ls, 1, 250), lambda page: of_page(key, page)))
