"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nz(c: Column) -> Column:
    """Null for blank text."""
    return F.when(F.trim(c) != "", c)


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def norm_sp(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def compact(c: Column) -> Column:
    return F.regexp_replace(norm_sp(c), " ", "")


def one_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def _compatible() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case characters of the basic plane that compatibility decomposition, without its marks, makes one ASCII
    letter or digit, and the letters among those that it makes several."""
    one, several = {}, {}
    for k in range(0xA0, 0x10000):
        c = chr(k)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if c == c.lower() and bare.isascii() and bare.isalnum():
            if len(bare) == 1:
                one[c] = bare
            elif unicodedata.category(c).startswith("L"):
                several[c] = bare
    return one, several


_ONE, _SEVERAL = _compatible()
ACCENTED, BARE = "".join(_ONE), "".join(_ONE.values())
MARKS = "[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]"


def plain(c: Column) -> Column:
    """Lower case without accents; anything but a-z and 0-9 is one space; trimmed.

    Accents go by compatibility decomposition: letters that have none, such as a barred l, are no letters here.
    """
    low = F.lower(c)
    for letter, bare in _SEVERAL.items():
        low = F.replace(low, F.lit(letter), F.lit(bare))
    return F.trim(F.regexp_replace(F.translate(F.regexp_replace(low, MARKS, ""), ACCENTED, BARE), "[^a-z0-9]+", " "))


def section_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def surname(c: Column) -> Column:
    """The last word, lower case."""
    return F.lower(F.element_at(F.split(strip(c), r"\s+"), -1))


def token_set(c: Column, least: int = 3) -> Column:
    """Distinct tokens of at least ``least`` letters or digits, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0))))


def fingerprint(c: Column) -> Column:
    return F.substring(F.sha2(norm_sp(c), 256), 1, 20)


def head_mid_tail(c: Column, most: int, middle: int) -> Column:
    """Texts over ``most`` characters as 45 % head, ``middle`` from the centre and 35 % tail."""
    head, tail = int(most * 0.45), int(most * 0.35)
    start = F.floor(F.length(c) / 2).cast("int") - middle // 2
    joined = F.concat(
        F.substring(c, 1, head), F.lit("\n[...]\n"), F.substring(c, start + 1, F.lit(middle)), F.lit("\n[...]\n"), F.right(c, F.lit(tail))
    )
    return F.when(F.length(c) > most, F.substring(joined, 1, most)).otherwise(c)


def doi(c: Column) -> Column:
    """The first DOI, lower case, without marks at its end."""
    found = F.regexp_extract(F.lower(c), r"(10\.[0-9]{4,9}/[-._;()/:a-z0-9]+)", 1)
    return nz(F.regexp_replace(found, r"[.,;:)]+$", ""))


def year(c: Column) -> Column:
    """The first year from 1900 to 2099, or null."""
    return nz(F.regexp_extract(c, "((?:19|20)[0-9]{2})", 1)).cast("int")


def first_line(c: Column, least: int, most: int, lines: int) -> Column:
    """The first of the first ``lines`` lines with ``least`` to ``most`` characters that starts with a capital."""
    candidates = F.filter(
        F.transform(F.slice(F.split(c, "\n"), 1, lines), lambda x: strip(x)),
        lambda x: (F.length(x) >= least) & (F.length(x) <= most) & x.rlike("^[A-Z]"),
    )
    return F.get(candidates, F.lit(0))


def headings(c: Column, most: int = 16, longest: int = 90) -> Column:
    """Distinct lines in capitals of 5 to ``longest`` characters, in order of appearance."""
    lines = F.transform(F.split(c, "\n"), lambda x: strip(x))
    shown = F.filter(lines, lambda x: (F.length(x) > 4) & (F.length(x) <= longest) & x.rlike("^[A-Z][A-Z0-9 .,!-]*$"))
    return F.slice(F.array_distinct(shown), 1, most)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two texts."""
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    same = F.filter(places, lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.coalesce(F.array_max(same), F.lit(0))


def file_name(c: Column) -> Column:
    """A safe file name: lower case, a-z 0-9 _ . -, no runs or chains of numbers, no reserved names."""
    x = F.lower(strip(F.coalesce(c, F.lit(""))))
    x = F.replace(F.replace(x, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" plus "))
    x = F.regexp_replace(x, "[^a-z0-9_.-]+", "_")
    x = F.regexp_replace(x, "_+", "_")
    for _ in range(3):
        x = F.regexp_replace(x, r"([_-]([0-9]{8}-[0-9]{6}|[0-9]{7,}))+$", "")
        x = F.regexp_replace(x, r"([_-][0-9]{1,4}){3,}$", "")
    x = F.regexp_replace(x, r"([_-](retry|copy|duplicate|recovered|staging))*$", "")
    x = F.regexp_replace(x, r"^[._ -]+|[._ -]+$", "")
    x = F.when(x == "", F.lit("file")).otherwise(x)
    reserved = F.split_part(x, F.lit("."), F.lit(1)).rlike("^(con|prn|aux|nul|com[1-9]|lpt[1-9])$")
    return F.when(reserved, F.concat(x, F.lit("_file"))).otherwise(x)


# Words that do not count in a title.
TITLE_STOP_WORDS = ("a", "an", "and", "as", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")


def title_tokens(c: Column) -> Column:
    """The words of a title with over two letters or digits, without stop words, in order."""
    stop = F.array(*[F.lit(w) for w in TITLE_STOP_WORDS])
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


# Fixed value: the form of an ISBN of 10 or 13 digits.
ISBN = r"\b(?:97[89][-\s]?)?[0-9][-\s]?[0-9]{2,5}[-\s]?[0-9]{2,7}[-\s]?[0-9]{1,7}[-\s]?[0-9X]\b"


def isbns(c: Column, most: int = 12) -> Column:
    """The first distinct numbers that look like an ISBN."""
    found = F.transform(F.regexp_extract_all(c, F.lit(ISBN), F.lit(0)), strip)
    digits = lambda x: F.regexp_replace(x, "[^0-9X]", "")
    good = lambda x: F.length(digits(x)).isin(10, 13) & digits(x).rlike("^(97|0|1)")
    return F.slice(F.array_distinct(F.filter(found, good)), 1, most)


def abstract(c: Column, most: int = 1600) -> Column:
    """What stands between the word abstract and the keywords, the introduction or a first numbered line."""
    found = F.regexp_extract(c, r"(?is)\babstract\b\s*(.+?)(?:\bkeywords\b|\bintroduction\b|\n\s*1[.\s]|$)", 1)
    return F.substring(one_space(found), 1, most)


def title_of_name(c: Column) -> Column:
    """A title from a file name: the words after its year, three at least, each with a capital; the year stands in no longer number."""
    stem = F.regexp_replace(c, r"\.(pdf|PDF)", "")
    after = F.regexp_extract(stem, r"(?s)(?<!\d)(?:19[0-9]{2}|20[0-2][0-9])(?!\d)[_\- ]*(.*)$", 1)
    after = F.regexp_replace(F.regexp_replace(after, r"_supplement_[0-9]+$", ""), r"_part_[0-9]+$", "")
    words = F.filter(F.split(after, r"[_\s]+"), lambda w: w != "")
    capital = lambda w: F.when((F.upper(w) == w) & (F.lower(w) != w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    return F.when(F.size(words) >= 3, F.array_join(F.transform(words, capital), " "))


# Parts of section names and their place in a pack, first match first.
SECTION_RANKS = (
    ("abstract", 0), ("introduction", 10), ("background", 15), ("method", 20), ("material", 25), ("procedure", 30), ("result", 40),
    ("finding", 45), ("table", 50), ("figure", 55), ("caption", 56), ("discussion", 60), ("limitation", 70), ("conclusion", 80),
    ("appendix", 90), ("supplement", 95), ("acknowledg", 100), ("reference", 110), ("bibliograph", 115),
)
OTHER_RANK = 50
# Parts of section names by bucket, first match first.
SECTION_BUCKETS = (
    ("references", ("reference", "bibliograph")),
    ("acknowledgements", ("acknowledg", "funding", "conflict", "author_contribution")),
    ("supplement", ("supplement", "appendix")),
    ("critical", ("abstract", "introduction", "background", "method", "result", "discussion", "limitation", "conclusion", "table", "figure", "caption")),
)


def section_rank(name: Column) -> Column:
    """Where a section stands in a pack."""
    found = F.coalesce(*[F.when(F.contains(section_key(name), F.lit(part)), F.lit(rank)) for part, rank in SECTION_RANKS], F.lit(OTHER_RANK))
    return found


def section_bucket(name: Column) -> Column:
    """What kind of section it is."""
    kinds = [F.when(section_key(name).rlike("|".join(parts)), F.lit(kind)) for kind, parts in SECTION_BUCKETS]
    return F.coalesce(*kinds, F.lit("standard"))


def joined_sections(sections: Column) -> Column:
    """A map of sections as one text, by rank and name, each below its name in capitals; blank ones are left out."""
    ranked = F.transform(F.map_entries(sections), lambda e: F.struct(section_rank(e["key"]).alias("rank"), e["key"].alias("key"), strip(e["value"]).alias("value")))
    filled = F.filter(F.array_sort(ranked), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.array_join(F.transform(filled, lambda e: F.concat(F.lit("=== "), F.upper(e["key"]), F.lit(" ===\n"), e["value"])), "\n\n")
