"""Titles: what disqualifies one, which of several to take, what poisons the identity of a row and how to mend it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.identity import usable
from vellum.functions.text import let

# Texts that are no titles, and the forms of numbers and lines that are none.
JUNK_TITLES = (
    "untitled",
    "unknown",
    "no title",
    "document",
    "microsoft word",
    "download",
    "exact paper title",
)
PII_PREFIX = r"(?i)^PII\s*:"
PII_VALUE = r"(?i)\bS?[0-9]{4}[-–][0-9]{4}\([0-9]{2}\)[0-9]{5}[-–]?[0-9]*\b"
DOI_VALUE = r"(?i)\b10\.[0-9]{4,9}/[^\s\])>\"']+"
ISSN = r"(?i)\bISSN[:\s-]*[0-9]{4}[-–]?[0-9]{3,4}[Xx0-9]?\b"
COPYRIGHT = r"(?i)©|copyright|\(c\)\s*[0-9]{4}"
POISONED_ID = r"(?i)(^|_)pii($|_)|unknown_pii|_pii_"
# Kinds of documents that are reference works.
REFERENCE_KINDS = ("handbook", "manual", "standard", "protocol", "guideline", "tutorial", "dictionary", "book", "book_chapter")
REFERENCE_NAME = r"\b(handbook|manual|standard|as[_-]?nzs|checklist|guideline|protocol)\b"
SUSPICIOUS = ("not_ratable_reference_material", "not_applicable")
# Sources of a title that need a number or a date beside them.
WEAK_SOURCES = ("filename", "filename_human", "filename_plain_title", "filename_plain_recovery", "pdf_embed", "first_page_heuristic")
WEAK_STATUSES = ("recovered_from_filename", "recovered_from_pdf_embed", "recovered_from_first_page")


def first_of(rules: tuple) -> Column:
    """The outcome of the first rule that holds, or null; a rule may have null as its outcome."""
    out = F.lit(None)
    for outcome, test in reversed(rules):
        out = F.when(test, outcome if isinstance(outcome, Column) else F.lit(outcome)).otherwise(out)
    return out


def one_line(c: Column) -> Column:
    """Runs of white space as one space, trimmed; null as blank."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def title_problem(title: Column) -> Column:
    """Why a text cannot stand as a title (19 reasons, the first that holds), or null."""
    return let(one_line(title), lambda t: let(F.lower(t), lambda low: let(t.rlike(PII_VALUE), lambda numbered: _problem(t, low, numbered))))


def _problem(t: Column, low: Column, numbered: Column) -> Column:
    size = F.length(t)
    names = F.size(F.regexp_extract_all(t, F.lit("[a-zA-Z]{2,}"), F.lit(0)))
    headed = low.rlike(r"^(psychophysiology|biological psychology|neuroscience letters)\b") & (size < 40)
    end = F.lower(F.regexp_extract(t, "([A-Za-z]+)[^A-Za-z]*$", 1))
    return first_of(
        (
            ("empty", size == 0),
            ("junk_literal", low.isin(*JUNK_TITLES)),
            (None, size.between(5, 7) & t.rlike("^[A-Za-z][A-Za-z'-]{3,}$")),
            ("too_short", size < 8),
            ("pii_prefix", t.rlike(PII_PREFIX)),
            ("pii_value", (numbered & (size < 40)) | F.replace(t, F.lit(" ")).rlike(rf"^(?:{PII_VALUE})$")),
            ("doi_only", t.rlike(rf"^(?:{DOI_VALUE})$") | (low.startswith("doi:") & t.rlike(DOI_VALUE))),
            ("issn_only", t.rlike(ISSN) & (size < 30)),
            ("copyright_line", t.rlike(COPYRIGHT) & (size < 80)),
            ("issue_metadata", low.rlike(r"^(vol\.|volume|issue|page|pp\.)\b")),
            ("journal_header_only", headed & ~low.rlike(" in | of |:")),
            ("pii_caps_header", numbered & t.rlike(r"^[A-Z0-9\s–().,/-]+$")),
            ("unknown_pii_title", low.rlike(r"\bunknown\s+pii\b")),
            ("pii_derived_title", low.rlike(r"\bpii\s*s?[0-9]*$")),
            ("pii_token_in_title", low.rlike(r"\bpii\b") & (size < 48) & ~low.rlike("polygraph|symposium")),
            ("author_line_not_title", low.rlike(r"^author\s*\(")),
            ("journal_header_not_title", low.rlike(r"^(international|the)\s+journal\s+of\b") | low.rlike(r"^the\s+(?:[a-z]+\s+){0,3}journal\s+of\b")),
            ("filename_extension_artifact", low.rlike(r"\.(pdf|docx?|pptx?)\b")),
            ("trailing_numeric_fragment", low.rlike(r"\b[0-9]{1,3}$") & (names <= 3) & (size < 45)),
            ("dangling_title_fragment", end.isin("de", "da", "di", "du", "fo") & (size < 80)),
        )
    )


def name_title(name: Column) -> Column:
    """The title that a file's name holds in plain words (12 characters or more and no problem), or null."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^.]*$", ""), "(?:_[0-9]{7,})+", " ")
    rest = lambda plain: F.when(F.contains(plain, F.lit(" - ")), F.regexp_replace(plain, "^.*? - ", "")).otherwise(F.regexp_replace(plain, "^[A-Za-z]+-", ""))
    cut = let(one_line(F.replace(stem, F.lit("_"), F.lit(" "))), rest)
    cut = F.trim(F.regexp_replace(F.trim(cut), "-[0-9]{4}-[A-Za-z]{2,12}$", ""))
    return let(cut, lambda t: F.when((F.length(t) >= 12) & title_problem(t).isNull(), t))


def id_title(own_id: Column) -> Column:
    """The title that an id holds behind its author (12 characters or more and no problem), or null."""
    pid = F.regexp_replace(F.coalesce(own_id, F.lit("")), "_b$", "")
    rest = F.regexp_extract(pid, "^[^_]*_(.*)$", 1)
    words = F.trim(F.replace(rest, F.lit("_"), F.lit(" ")))
    good = F.contains(pid, F.lit("_")) & (F.lower(rest) != "pii") & ~F.lower(rest).endswith("_pii")
    return let(words, lambda t: F.when(good & (F.length(t) >= 12) & title_problem(t).isNull(), t))


def candidates(*found: tuple[str, Column, float]) -> Column:
    """An array of the titles found, each (source, title, confidence), with what is wrong with it; blank ones left out."""
    one = lambda source, t, sure: F.struct(one_line(t).alias("title"), F.lit(source).alias("source"), F.lit(float(sure)).alias("confidence"))
    shown = F.filter(F.array(*[one(*x) for x in found]), lambda x: x["title"] != "")
    return F.transform(shown, lambda x: x.withField("problem", title_problem(x["title"])))


def surest(found: Column) -> Column:
    """The candidate without a problem that is surest; of equals the one whose title, in any case, came up first; or null."""

    def rated(shown: Column, keys: Column) -> Column:
        return F.transform(
            F.filter(shown, lambda x: x["problem"].isNull()),
            lambda x, i: F.struct(x["confidence"].alias("confidence"), (-F.array_position(keys, F.lower(x["title"]))).alias("place"), (-i).alias("own"), x.alias("x")),
        )

    best = lambda shown: let(F.transform(shown, lambda x: F.lower(x["title"])), lambda keys: F.array_max(rated(shown, keys)))
    return let(found, best)["x"]


def identity_status(chosen: Column, chain_source: Column) -> Column:
    """How an identity was won, by the source of its title (for ``metadata_chain`` the source that the chain names)."""
    source = chosen["source"]
    named = F.when((source == "metadata_chain") & (F.coalesce(chain_source, F.lit("")) != ""), chain_source).otherwise(source)
    return first_of(
        (
            ("insufficient_identity", chosen.isNull()),
            ("recovered_from_filename", named.startswith("filename")),
            ("recovered_from_first_page", named == "first_page_heuristic"),
            (F.concat(F.lit("recovered_from_"), named), named.isin("pdf_embed", "crossref", "claude", "ollama")),
            ("insufficient_identity", chosen["confidence"] < 0.5),
            ("high_confidence", F.lit(True)),
        )
    )


def identity_problem(title: Column, source: Column, chain_source: Column, status: Column, authors: Column, year: Column, doi: Column, journal: Column) -> Column:
    """Why an identity is too weak for the catalogue, or null."""
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    weak = F.coalesce(source, F.lit("")).startswith("filename") | F.coalesce(chain_source, F.lit("")).isin(*WEAK_SOURCES) | status.isin(*WEAK_STATUSES)
    words = F.size(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("[A-Za-z][A-Za-z'-]{2,}"), F.lit(0)))
    poor = status == "insufficient_identity"
    bare = weak & blank(doi)
    problem = lambda own: first_of(
        (
            (own, own.isNotNull()),
            (None, poor & usable(title, authors, year, doi, F.lit(False))),
            ("insufficient_identity", poor),
            ("weak_identity_title_fragment", bare & (words < 4)),
            ("weak_identity_lacks_bibliographic_anchor", bare & blank(year) & blank(journal) & (words < 5)),
        )
    )
    return let(title_problem(title), problem)


def poison_signals(row: dict[str, Column]) -> Column:
    """All signs that the identity of a row is spoilt, in order; none for rows that were settled (``resolved``).

    ``row`` has id, title, renamed, original, pii, rating, flagged, survived, chars and resolved; null is blank.
    """
    text = {k: F.coalesce(row[k], F.lit("")) for k in ("id", "title", "renamed", "original", "pii", "rating")}
    title, low = text["title"], F.lower(text["title"])
    problem, other = title_problem(title), name_title(text["original"])
    spoilt = problem.isNotNull() | F.upper(title).startswith("PII:")
    named = (text["original"] != "") & (text["renamed"] != "") & other.isNotNull()
    differs = F.substring(F.lower(other), 1, 20) != F.substring(low, 1, 20)
    title_sign = first_of(
        (("empty_title", F.trim(title) == ""), ("pii_prefix_title", F.upper(title).startswith("PII:")), (F.concat(F.lit("invalid_title:"), problem), problem.isNotNull()))
    )
    signs = F.array(
        title_sign,
        F.when(text["id"].rlike(POISONED_ID), "poisoned_paper_id"),
        F.when(F.contains(F.lower(text["renamed"]), F.lit("pii")), "poisoned_source_filename"),
        F.when((text["pii"] != "") & (F.trim(title) != "") & F.contains(F.trim(low), F.lower(F.trim(text["pii"]))), "title_contains_stored_pii"),
        F.when(named & spoilt, "filename_has_better_title").when(named & differs & text["renamed"].rlike(POISONED_ID), "title_filename_identity_mismatch"),
        F.when(text["rating"].isin(*SUSPICIOUS), F.concat(F.lit("suspicious_rating:"), text["rating"])),
        F.when(row["flagged"], "prior_guard_or_reeval_flag"),
        F.when(text["rating"].startswith("not_") & ~F.coalesce(row["survived"], F.lit(False)) & (row["chars"] >= 2000), "red_team_skipped_with_substantial_text"),
    )
    return F.when(F.coalesce(row["resolved"], F.lit(False)), F.array().cast("array<string>")).otherwise(F.array_compact(signs))


def reference_work(kind: Column, name: Column, article: Column, reference: Column) -> Column:
    """Whether a row is a reference work in earnest, by its kind, the name of its file and its signals."""
    return (
        F.when(F.coalesce(F.lower(kind).isin(*REFERENCE_KINDS), F.lit(False)), True)
        .when(F.lower(F.coalesce(name, F.lit(""))).rlike(REFERENCE_NAME), reference >= article)
        .otherwise((reference >= 2) & (article <= 1))
    )


def repair_bucket(row: dict[str, Column], signs: Column, owner: Column, repair: Column, article: Column, genuine: Column) -> Column:
    """What is to be done with a row of spoilt identity: bucket, reason and confidence.

    ``repair`` is the title to put in (a candidate, or null), ``owner`` the state of the row's file.
    """
    title, rating, pii = (F.coalesce(row[k], F.lit("")) for k in ("title", "rating", "pii"))
    made = lambda bucket, reason, sure: F.struct(F.lit(bucket).alias("bucket"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), (sure if isinstance(sure, Column) else F.lit(sure)).cast("double").alias("confidence"))
    spoilt = F.exists(signs, lambda s: s.rlike("^(pii_|invalid_title|empty_title|poisoned_|title_filename)"))
    bad_id, bad_name = F.coalesce(row["id"], F.lit("")).rlike(POISONED_ID), F.array_contains(signs, "poisoned_source_filename")
    clean = ~bad_id & ~F.contains(F.lower(F.coalesce(row["renamed"], F.lit(""))), F.lit("pii"))
    none, sure = repair.isNull(), F.coalesce(repair["confidence"], F.lit(0.0))
    changes = (repair["source"] != "existing_valid_title") & (F.lower(repair["title"]) != F.trim(F.lower(title)))
    retitle = title_problem(title).isNotNull() | F.coalesce(changes, F.lit(False))
    fix = ~none & (retitle | bad_id | bad_name)
    suspicious = rating.isin(*SUSPICIOUS) & F.exists(signs, lambda s: s.startswith("suspicious_rating"))
    stay = "already_valid_identifier_only"
    return first_of(
        (
            (made("source_ownership_problem", owner, 0.0), owner.isin("ambiguous", "unowned", "missing_source_pdf")),
            (made(stay, "pii_stored_as_identifier", 1.0), (pii != "") & ~spoilt & clean),
            (made("uncertain_manual_review", "no_deterministic_title_recovery", 0.0), none & spoilt),
            (made(stay, "genuine_reference_material", 0.9), none & suspicious & genuine),
            (made("mark_for_reevaluation", "journal_article_suspicious_rating", 0.85), none & suspicious & (article >= 2)),
            (made(stay, "no_repair_needed", 1.0), none),
            (made("uncertain_manual_review", "title_recovery_confidence_too_low", sure), fix & retitle & (sure < 0.65)),
            (made("deterministic_repair_safe", "deterministic_identity_recovery", sure), fix & retitle),
            (made("deterministic_repair_safe", "deterministic_identity_recovery", F.greatest(sure, F.lit(0.9))), fix),
            (made("mark_for_reevaluation", "poisoned_classification_journal_article", 0.8), rating.startswith("not_") & ~genuine & (article >= 2)),
            (made("uncertain_manual_review", "insufficient_confidence_for_auto_repair", 0.0), spoilt),
            (made(stay, "stable", 1.0), F.lit(True)),
        )
    )


# Titles and names of what is not applicable.
NOT_APPLICABLE = (
    "last word from",
    "supplementary material",
    "supplement for",
    "reply to",
    "committee report",
    "osf prereg",
    "panel discussion",
    "copyediting specification",
    "abstracts [0-9]{4}",
    "^erratum to ",
    "^corrigendum to ",
)
# Titles and names of reference works.
NOT_RATABLE = (
    "springerbriefs",
    "media effects:",
    "treating attachment disorders",
    "eye movement research: an introduction",
    "designing experiments and analyzing data",
    "for dummies",
    "user manual",
    "guideline thirteen",
    "product manual",
    "handbook of ",
    "edited volume",
    "second edition",
    "model comparison perspective",
    "physiology of the autonomic nervous system",
    "complete reference guide to the elsevier",
)


def readiness(row: dict[str, Column], article: Column, reference: Column, genuine: Column, non_ratable: Column) -> Column:
    """What a row needs before it counts as done: an action and the reason."""
    title, name, rating = (F.lower(F.coalesce(row[k], F.lit(""))) for k in ("title", "renamed", "rating"))
    either = lambda marks: title.rlike("|".join(marks)) | name.rlike("|".join(marks))
    made = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    suspicious, long = rating.isin(*SUSPICIOUS), row["chars"] >= 200
    contested = suspicious & (article >= 2) & (reference <= 1)
    return first_of(
        (
            (made("confirm_not_applicable", "title_or_filename_editorial_or_supplement"), either(NOT_APPLICABLE)),
            (made("confirm_non_ratable", "title_or_filename_reference_material"), either(NOT_RATABLE)),
            (made("confirm_non_ratable", "reference_material_signals"), genuine),
            (made("confirm_non_ratable", "corpus_classifier"), non_ratable),
            (made("sonnet_evaluate", "journal_article_signals_with_suspicious_rating"), contested & long),
            (made("confirm_not_applicable", "insufficient_text_for_research_eval"), contested),
            (made("confirm_not_applicable", "retain_non_research_classification"), suspicious),
            (made("sonnet_evaluate", "explicit_reevaluation_flag"), row["flagged"] & long),
            (made("confirm_not_applicable", "reevaluation_flag_but_insufficient_text"), row["flagged"]),
            (made("already_complete", "no_action_needed"), F.lit(True)),
        )
    )


def input_health(title: Column, authors: Column, year: Column, doi: Column, status: Column, extractor: Column, chars: Column, coverage: Column, journal: Column, can_rate: Column, first_pass: Column) -> Column:
    """Whether a document may be rated, and the reasons; in a first pass a usable identity and a longer text let it through."""
    known = F.coalesce(status, F.lit(""))
    poor = known == "insufficient_identity"
    saved = first_pass & usable(title, authors, year, doi, F.lit(True))
    uncovered = journal & ~can_rate
    partly = first_pass & (chars >= 2000) & ~known.isin("", "insufficient_identity")
    invalid, scant = title_problem(title).isNotNull(), (F.coalesce(extractor, F.lit("")) != "TEXT_OK") & (chars < 200)
    reasons = F.array(
        F.when(invalid, "invalid_title"),
        F.when(scant, "insufficient_text"),
        F.when(poor & saved, "first_pass_identity_recovered").when(poor, "insufficient_identity"),
        F.when(uncovered & partly, F.concat(F.lit("first_pass_partial_coverage:"), coverage)).when(uncovered, F.concat(F.lit("insufficient_coverage:"), coverage)),
    )
    barred = invalid | scant | (poor & ~saved) | (uncovered & ~partly)
    return F.struct((~barred).alias("can_evaluate"), F.array_compact(reasons).alias("reasons"))
