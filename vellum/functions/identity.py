"""Rules over identities: ids, names, titles, years, duplicates, retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import nz, plain

# What each class of content becomes, and the public name of each action.
DISPOSITION = {
    "DELETE": (
        "CONFIRMED_DUPLICATE",
        "TRUE_CORRUPT_UNUSABLE",
        "HTML_OR_TEXT_JUNK",
        "MIME_OR_WRAPPER_JUNK",
    ),
    "PENDING": (
        "VALID_PDF_CHILD_DOCUMENT",
        "VALID_NONPDF_CHILD_DOCUMENT",
        "VALID_NONPDF_DATASET_OR_MEDIA_SUPPLEMENT",
        "HTML_OR_TEXT_CHILD_DOCUMENT",
        "MIME_OR_WRAPPER_RECOVERABLE",
        "ARCHIVE_CHILD_DOCUMENT",
        "MODEL_RECOVERY_REQUIRED",
    ),
    "STAGING": (
        "VALID_PDF_STANDALONE_RESEARCH",
        "VALID_PDF_NON_RATABLE_REFERENCE",
        "VALID_NONPDF_REFERENCE",
        "HTML_OR_TEXT_REFERENCE",
    ),
}
TERMINAL = {
    "INGEST_RESEARCH_PAPER": "ACCEPT_RESEARCH", "INGEST_NON_RATABLE_REFERENCE": "ACCEPT_REFERENCE", "LINK_CHILD_TO_PARENT": "LINK_CHILD",
    "HOLD_PENDING_PARENT": "HOLD_PENDING_CHILD", "DELETE_CONFIRMED_DUPLICATE": "DELETE_DUPLICATE", "DELETE_CONFIRMED_JUNK": "DELETE_JUNK",
    "DELETE_TRUE_CORRUPT_UNUSABLE": "DELETE_CORRUPT", "DELETE_UNRECOVERABLE_AFTER_FULL_ADJUDICATION": "DELETE_UNRECOVERABLE",
    "SYSTEM_INTEGRITY_FAILURE": "SYSTEM_INTEGRITY_FAILURE",
}
LIGHTS = {
    "green": "green", "yellow": "yellow", "red": "red", "info": "info", "na": "na", "fail": "fail", "no problems detected": "green",
    "something to check": "yellow", "possible problems detected": "red", "informational only": "info",
}
# Patterns of ids to be renamed.
WEIRD_PATTERNS = (
    "^1_s2_0_",
    "^BF[0-9]{6,}$",
    "^[0-9]{8,}_[0-9]{12,}",
    "UOW[0-9]+",
    "^orphan_",
    "^s[0-9]{5}_[0-9]+",
    "^[0-9]{4}_[0-9]{4}_",
    "^[0-9]{4}_[0-9]{5}_[0-9]{3}$",
    "^[0-9]{4}_[0-9]{4,}_[A-Za-z0-9_]+_S[0-9]+$",
    "^_pdf$",
    "^_[A-Z]",
    "[A-Za-z]+Unknown$",
    "_Year_Unknown$",
)
WEIRD = "|".join(WEIRD_PATTERNS)
# The form of a name to be kept, and endings that show a cut title.
RELIABLE = "^[A-Z][a-zA-Z]{2,30}_[0-9]{4}_[A-Za-z][a-zA-Z]{2,50}$"
JUNK_TAILS = (
    "unknow",
    "situatio",
    "situation",
    "international",
    "handbook",
    "auth",
    "main",
)
JUNK_TAIL = f"({'|'.join(JUNK_TAILS)})[0-9]*$"
# Other spellings of ratings.
RATING_ALIASES = {"moderate": "adequate", "junk": "flawed"}
ORPHAN_TAILS = (
    "__supplement$",
    "_supplement_[0-9]+$",
    "_[sS]upplement$",
    "_supp[0-9]+$",
)
ORPHAN = "|".join(ORPHAN_TAILS)


def lookup(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    """A fixed mapping."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(default))


def weird_id(c: Column) -> Column:
    return c.rlike(WEIRD)


def reliable_id(c: Column) -> Column:
    return c.rlike(RELIABLE) & ~F.lower(c).rlike(JUNK_TAIL)


def legacy_id(c: Column) -> Column:
    """Ids of earlier schemes: orphans, publishers' codes, unknown names, bare numbers."""
    return c.rlike("^(orphan_|1_s2_0_|BF|_|[0-9]{8,}_|[0-9]+$)") | c.contains("Unknown")


def rating_label(c: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s-]+", "_")
    return F.coalesce(lookup(plain, RATING_ALIASES), plain)


def disposition(c: Column) -> Column:
    flat = {name: kind for kind, names in DISPOSITION.items() for name in names}
    return lookup(c, flat, "MODEL_RECOVERY")


def hash_like(stem: Column) -> Column:
    """File stems that say nothing: digits, hexadecimal codes, downloads."""
    compact = F.replace(stem, F.lit("-"), F.lit(""))
    return (
        stem.rlike("^-?[0-9]{5,}$")
        | ((F.length(compact) >= 16) & F.lower(compact).rlike("^[0-9a-f]+$"))
        | F.lower(stem).isin("download", "download (1)", "untitled")
    )


def unsafe_id(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).eqNullSafe("") | F.lower(c).contains("unknown")


def truncated_title(c: Column) -> Column:
    t = F.trim(c)
    return F.coalesce((F.length(c) < 40) | ~F.right(t, F.lit(1)).rlike("[A-Za-z0-9.?!]"), F.lit(True))


def poisoned_year(year: Column, doi: Column) -> Column:
    """Not a year from 1950 to 2035, or one that only echoes the DOI."""
    y = F.trim(F.coalesce(year, F.lit("")))
    digits = y.rlike("^[0-9]+$")
    number = F.when(digits & (F.length(y) < 9), y.cast("int"))
    plain = F.translate(F.coalesce(doi, F.lit("")), "/-", "")
    return ~digits | F.coalesce(~number.between(1950, 2035), F.lit(True)) | ((plain != "") & F.contains(plain, y))


def usable(title: Column, authors: Column, year: Column, doi: Column, forced: Column) -> Column:
    """Enough identity to rate a document."""
    t, y = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(year, F.lit("")))
    named = F.exists(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.length(F.trim(a)) > 2)
    dated = F.when(y.rlike("^[0-9]{4}$"), y.cast("int").between(1950, 2035)).otherwise(False)
    return (F.length(t) >= 12) & named & (dated | (F.length(F.trim(F.coalesce(doi, F.lit("")))) >= 8) | (forced & (F.length(t) >= 20)))


def signals_confirm(s: Column) -> Column:
    """Whether signals of likeness make a confirmed duplicate."""
    title, abstract = F.exists(s, lambda x: x.startswith("title_")), F.exists(s, lambda x: x.startswith("abstract_"))
    has = lambda x: F.array_contains(s, x)
    return has("content_hash") | (has("doi") & (F.size(s) >= 2)) | (has("author") & title & (has("year") | abstract))


def blocked_retry(count: Column, last: Column, reason: Column) -> Column:
    n = F.coalesce(count, F.lit(0))
    return (n >= 1) & (((F.coalesce(last, F.lit("")) != "") & (last == reason)) | (n >= 2))


def second_opinion(action: Column, confidence: Column) -> Column:
    """Deletes need 0.95, others 0.70."""
    return confidence < F.when(action.startswith("DELETE"), 0.95).otherwise(0.70)


def duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("int")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return (
        F.when(seconds.isNull() | (seconds < 0), "unknown")
        .when(h > 0, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), two(r), F.lit("s")))
        .otherwise(F.concat(r.cast("string"), F.lit("s")))
    )


def era(year: Column) -> Column:
    return F.when(year.isNull(), "unknown_year").when(year < 1990, "pre_1990").when(year < 2010, "1990_2009").when(year < 2020, "2010_2019").otherwise("2020_plus")


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return F.round(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 6)


def in_currency(usd: Column, rate: Column) -> Column:
    return F.when(rate > 0, F.round(usd * rate, 2))


def article_guard(rating: Column, journal: Column, reference: Column, insufficient: Column) -> Column:
    """Blocks the verdict not ratable where the signs of an article prevail."""
    r = F.replace(F.lower(F.coalesce(rating, F.lit(""))), F.lit("-"), F.lit("_"))
    bad = r.isin("not_ratable_reference_material", "not_applicable", "not applicable")
    return F.when((journal >= 2) & (reference <= 1) & bad, "blocked:insufficient_evidence").when(
        (r == "not_applicable") & (insufficient >= 1) & (journal >= 1), "blocked:identity_or_extraction_problem"
    ).otherwise("allowed")


def richness(title: Column, authors: Column, year: Column, doi: Column, abstract: Column, tags: Column, rating: Column, survived: Column) -> Column:
    """How much a row's metadata holds; the row with most is kept."""
    on = lambda c, w: F.when(nz(c.cast("string")).isNotNull(), w).otherwise(0)
    n = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    return (
        F.length(F.coalesce(title, F.lit(""))) + 10 * n(authors) + on(year, 5) + on(doi, 20)
        + F.floor(F.length(F.coalesce(abstract, F.lit(""))) / 10) + n(tags) + on(rating, 50) + F.when(F.coalesce(survived, F.lit(False)), 50).otherwise(0)
    ).cast("int")


def name_quality(name: Column) -> Column:
    """Lower is better: clean names that people can read."""
    n = F.lower(name)
    when = lambda c, w: F.when(c, w).otherwise(0)
    return (
        when(n.startswith("1-s2.0-") | n.startswith("1_s2_0_"), 1000) + when(n.contains("unknown_unknown"), 2000) + when(name.rlike(r"\([0-9]\)"), 500)
        + when(name.contains("_main"), 200) - when(name.rlike("^[a-z]+_[0-9]{4}_"), 500) - when(name.rlike("^[a-z]+_[a-z]+_"), 100) + F.length(name)
    )


# Fixed value: ends of titles that were cut off.
CUT_TITLE = r"(?i)\s+(or|hyp|a|m|1|h\s*1|s\s*u|n[oa]|the)$|[^a-z0-9]$|_[0-9]$"


def cut_title(title: Column) -> Column:
    """Whether a title is short or looks cut off."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), r"^\s+|\s+$", "")
    return (F.length(F.coalesce(title, F.lit(""))) < 40) | ~bare.rlike(r"[\p{L}\p{N}.?!]$") | bare.rlike(CUT_TITLE)


def title_ratio_from(a: Column, b: Column) -> Column:
    """From where on :func:`likely_duplicates` must know the ratio of the titles; null where it does not ask for it."""
    settled = (a["doi"] != "") & (a["doi"] == b["doi"])
    return F.when(~settled & (a["key"] != "") & (b["key"] != ""), F.when(~cut_title(a["title"]) & ~cut_title(b["title"]), 0.95).otherwise(0.5))


def abstract_ratio_from(a: Column, b: Column, title_ratio: Column) -> Column:
    """The same of the abstracts, once the ratio of the titles is known."""
    clean_a, clean_b = ~cut_title(a["title"]), ~cut_title(b["title"])
    settled = ((a["doi"] != "") & (a["doi"] == b["doi"])) | (clean_a & clean_b & (title_ratio < 0.95))
    told = (F.length(a["abstract"]) >= 100) & (F.length(b["abstract"]) >= 100)
    return F.when(~settled & told, F.when(~clean_a & ~clean_b, 0.92).otherwise(0.85))


def likely_duplicates(a: Column, b: Column, title_ratio: Column, abstract_ratio: Column, same_prefix: Column) -> Column:
    """Whether two records are surely one paper.

    ``a`` and ``b`` have the text fields id, doi, title, key (the title normalised),
    abstract and file, blank where unknown; the ratios are those of keys and of
    abstracts (0 where one is blank), ``same_prefix`` the length of the ids' common prefix.
    """
    both = lambda f: (a[f] != "") & (b[f] != "")
    same = lambda f: both(f) & (a[f] == b[f])
    size = lambda x: F.length(x["abstract"])
    clean_a, clean_b = ~cut_title(a["title"]), ~cut_title(b["title"])
    told = (size(a) >= 100) & (size(b) >= 100)
    least = F.when(~clean_a & ~clean_b, 0.92).otherwise(0.85)
    made_up = lambda x: (x["key"] == "") | (x["key"] == plain(x["id"]))
    cut_ids = (same_prefix >= 50) & (F.length(a["id"]) - same_prefix <= 4) & (F.length(b["id"]) - same_prefix <= 4)
    return (
        F.when(same("doi"), True)
        .when(clean_a & clean_b & (title_ratio < 0.95), False)
        .when(told & (abstract_ratio < least), False)
        .when(told & (abstract_ratio >= 0.92) & (size(a) >= 200) & (size(b) >= 200), True)
        .when(same("key") | (both("key") & (title_ratio >= 0.92)), True)
        .when(same("file") & ((title_ratio >= 0.5) | made_up(a) | made_up(b)), True)
        .otherwise(cut_ids & (same("key") | same("file")))
    )


# Parts of what is no person's name.
NO_NAME = (
    "also available", "altering fate", "consciousness", "deception", "development", "emotion and", "guilford", "handbook", "isbn",
    "lying", "mind in context", "past does not predict", "psychological construction", "rise of consciousness",
)


def person_name(c: Column) -> Column:
    """Whether a text looks like a person's name: two to five words, two of them with a capital."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), r"^[ ,.;:]+|[ ,.;:]+$", "")
    words = F.split(clean, " ")
    long = F.filter(words, lambda w: F.length(F.regexp_replace(w, "[^A-Za-z-]", "")) >= 2)
    capital = F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))
    sizes = F.length(clean).between(5, 80) & F.size(words).between(2, 5) & (F.size(long) >= 2) & (F.size(capital) >= 2)
    return sizes & ~F.lower(clean).rlike("|".join(NO_NAME))


def path_owner(path: Column, owners: Column, supplement_owners: Column) -> Column:
    """Who owns a path: the rows that name it, else the folder it lies in, else its ending."""
    low = F.lower(path)
    below = lambda folder: F.contains(low, F.lit(f"/{folder}/"))
    return (
        F.when(owners == 1, "db_owned_source_pdf")
        .when(owners > 1, "db_owned_source_pdf_ambiguous")
        .when(supplement_owners == 1, "source_pdf_supplement_child")
        .when(supplement_owners > 1, "source_pdf_supplement_child_ambiguous")
        .when(below("source_pdfs"), "source_pdf_unowned_or_unmatched")
        .when(below("staging_metadata") | low.endswith(".staging.json"), "sidecar")
        .when(below("pending_parent") & low.endswith(".pending.json"), "sidecar")
        .when(below("pending_parent"), "pending_child_support_doc")
        .when(below("staging"), "staging_file")
        .when(below("backups"), "backup")
        .when(below("logs"), "log")
        .when(below("audit"), "audit")
        .when(below("cache"), "cache")
        .when(low.rlike(r"[.](py|md|txt|toml|yaml|yml|json|csv)$"), "code_config")
        .otherwise("unknown_runtime_file")
    )


def usable_title(title: Column) -> Column:
    """Whether a file's own title may be used: not the name of a draft, not digits only, eight letters at least."""
    low = F.lower(title)
    draft = low.endswith(".indd") | low.endswith(".pdf") | F.contains(low, F.lit("print.indd"))
    sized = F.length(F.regexp_replace(title, r"^\s+|\s+$", "")) >= 8
    return F.coalesce((title != "") & ~draft & ~title.rlike("^[0-9_ -]{4,}$") & sized, F.lit(False))


# What an id begins with that must be looked at by hand.
MALFORMED_ID = "^_[A-Za-z]"


def rename_problem(old: Column, new: Column, surname: Column, year: Column, title: Column) -> Column:
    """Why an id is not renamed; null if it may be."""
    return (
        F.when(old.rlike(MALFORMED_ID), "malformed_id_needs_manual")
        .when(old.startswith("orphan_") & ~reliable_id(new), "orphan_id_needs_manual")
        .when(new.startswith("orphan_"), "orphan_output_needs_manual")
        .when(unsafe_id(new), "unsafe_generated_id")
        .when(~reliable_id(new), "unreliable_generated_id")
        .when((F.coalesce(surname, F.lit("")) == "") | ~F.coalesce(year, F.lit("")).rlike("^[0-9]+$") | (F.length(F.trim(F.coalesce(title, F.lit("")))) < 8), "insufficient_metadata_for_rename")
    )
