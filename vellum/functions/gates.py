"""Ordered ladders that class a document by the evidence it carries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST, USABLE, WHOLE = 200, 2000, 8000

REFERENCE_KINDS = [
    "reference_material", "manual", "handbook", "standard", "book", "book_chapter", "conference_abstract",
    "conference_proceedings", "poster_or_abstract", "thesis", "protocol",
]


def coverage(length: Column, extractor: Column, journal: Column, sections: Column, pages: Column) -> Column:
    """What a text's length, its extraction and its sections say about its coverage."""
    ok = F.coalesce(extractor, F.lit("TEXT_OK")).isin("TEXT_OK", "")
    low = length < WHOLE
    status = (
        F.when(extractor == "OCR_REQUIRED", "OCR_REQUIRED")
        .when(extractor == "OCR_FAILED", "OCR_FAILED")
        .when(~ok & (length < LEAST), "EXTRACTION_FAILED")
        .when(length < LEAST, "INSUFFICIENT_FOR_EVALUATION")
        .when(journal & (sections == 1) & low, "INSUFFICIENT_FOR_EVALUATION")
        .when(journal & low & (F.coalesce(pages, F.lit(0)) > 1), "PARTIAL_NEEDS_RECOVERY")
        .when(journal & low, "INSUFFICIENT_FOR_EVALUATION")
        .when(journal & (sections >= 2), "COMPLETE_ENOUGH")
        .when(journal, "PARTIAL_BUT_USABLE")
        .when(length >= WHOLE, "COMPLETE_ENOUGH")
        .when(length >= USABLE, "PARTIAL_BUT_USABLE")
        .otherwise("INSUFFICIENT_FOR_EVALUATION")
    )
    return status


def permissions(status: Column, length: Column, journal: Column, reference: Column) -> Column:
    """What a coverage allows: a rating, the verdict not applicable, standing as reference material."""
    short_journal = journal & (length < WHOLE) & ~reference
    rate = status.isin("COMPLETE_ENOUGH", "PARTIAL_BUT_USABLE") & (~journal | (length >= USABLE)) & ~short_journal
    other = (~journal | reference) & ~status.isin("EXTRACTION_FAILED", "OCR_REQUIRED", "OCR_FAILED") & ~short_journal
    return F.struct(rate.alias("can_rate"), other.alias("can_not_applicable"), reference.alias("can_reference"))


def acceptance(status: Column, length: Column, extractor: Column, journal: Column, may: Column, kind: Column, duplicate: Column, identity_problem: Column, preclassified: Column) -> Column:
    """The single action that a document's evidence leads to."""
    ok = F.coalesce(extractor, F.lit("TEXT_OK")).isin("TEXT_OK", "")
    as_reference = F.lower(F.coalesce(kind, F.lit(""))).isin(*REFERENCE_KINDS)
    weak = status.isin("PARTIAL_NEEDS_RECOVERY", "INSUFFICIENT_FOR_EVALUATION", "EXTRACTION_FAILED")
    recover = status.isin("PARTIAL_NEEDS_RECOVERY", "OCR_REQUIRED", "OCR_FAILED")
    neither = journal & ~may["can_rate"] & ~may["can_not_applicable"] & ~(preclassified & as_reference)
    stopped = weak & ((journal & ~(preclassified & as_reference)) | ~preclassified)
    reference = (preclassified | as_reference) & may["can_reference"] & (~journal | may["can_not_applicable"])
    return (
        F.when(duplicate, "REJECT_DUPLICATE")
        .when(identity_problem, "REJECT_INSUFFICIENT_EVIDENCE")
        .when(extractor.isin("OCR_FAILED", "OCR_REQUIRED"), "REJECT_NEEDS_RECOVERY")
        .when(~ok & (length < LEAST), "REJECT_CORRUPT_OR_UNUSABLE")
        .when((length < LEAST) & ~preclassified, "REJECT_INSUFFICIENT_EVIDENCE")
        .when(neither & recover, "REJECT_NEEDS_RECOVERY")
        .when(neither, "REJECT_INSUFFICIENT_EVIDENCE")
        .when(stopped & (status == "PARTIAL_NEEDS_RECOVERY"), "REJECT_NEEDS_RECOVERY")
        .when(stopped, "REJECT_INSUFFICIENT_EVIDENCE")
        .when(reference, "ACCEPT_REFERENCE")
        .when((preclassified | as_reference) & journal & ~may["can_reference"], "REJECT_INSUFFICIENT_EVIDENCE")
        .when(may["can_rate"] & status.isin("COMPLETE_ENOUGH", "PARTIAL_BUT_USABLE"), "ACCEPT_RESEARCH")
        .otherwise("REJECT_INSUFFICIENT_EVIDENCE")
    )


PREVIEW = 20


def extraction(file: dict[str, Column]) -> Column:
    """Status of a file's extraction, and behind a colon the source of the text, by extractors tried in turn.

    ``file``: exists, is_pdf, header_ok, tool (ok, not_found, crashed), preview, native,
    second and ocr (text lengths), ocr_state (not_asked, unavailable, failed, ran), pages, size.
    Other files' previews and texts by OCR need ``PREVIEW`` characters, texts of a PDF ``LEAST``.
    """
    n = lambda k: F.coalesce(file[k], F.lit(0))
    best = F.when(n("second") > n("native"), "second").otherwise("native")
    readable = n("pages") >= 1
    return (
        F.when(~file["exists"], "WRONG_PATH_OR_MISSING_FILE:none")
        .when(~file["is_pdf"] & (n("preview") >= PREVIEW), "TEXT_OK:preview")
        .when(~file["is_pdf"], "TRUE_EMPTY_TEXT:preview")
        .when(~file["header_ok"], "CORRUPT_OR_UNREADABLE:none")
        .when(file["tool"] == "not_found", "EXTRACTOR_UNAVAILABLE:none")
        .when(file["tool"] == "crashed", "EXTRACTOR_CRASHED:none")
        .when(n("native") >= LEAST, "TEXT_OK:native")
        .when((n("second") > n("native")) & (n("second") >= LEAST), "TEXT_OK:second")
        .when((file["ocr_state"] == "not_asked") & readable, F.concat(F.lit("OCR_REQUIRED:"), best))
        .when(file["ocr_state"] == "not_asked", F.concat(F.lit("TRUE_EMPTY_TEXT:"), best))
        .when(file["ocr_state"] == "unavailable", F.concat(F.lit("EXTRACTOR_UNAVAILABLE:"), best))
        .when(n("ocr") >= PREVIEW, "TEXT_OK:ocr")
        .when(file["ocr_state"] == "failed", F.concat(F.lit("OCR_FAILED:"), best))
        .when(readable & (n("size") >= 500), F.concat(F.lit("TRUE_EMPTY_TEXT:"), best))
        .otherwise(F.concat(F.lit("CORRUPT_OR_UNREADABLE:"), best))
    )


def extraction_action(status: Column) -> Column:
    """What becomes of a file whose extraction failed."""
    return (
        F.when(status.isin("EXTRACTOR_UNAVAILABLE", "EXTRACTOR_CRASHED", "WRONG_PATH_OR_MISSING_FILE", "OCR_FAILED"), "SYSTEM_INTEGRITY_FAILURE")
        .when(status.isin("TRUE_EMPTY_TEXT", "CORRUPT_OR_UNREADABLE"), "DELETE_TRUE_CORRUPT_UNUSABLE")
        .when(status == "UNSUPPORTED_CONTENT_TYPE", "DELETE_CONFIRMED_JUNK")
        .otherwise("DELETE_UNRECOVERABLE_AFTER_FULL_ADJUDICATION")
    )


# Marks in file names, in the order in which they decide.
SUPPLEMENT_MARKS = (
    "supplement",
    "_supp",
    "-supp",
    "appendix",
    "mmc",
    "supporting information",
)
SUPPLEMENT = "|".join(SUPPLEMENT_MARKS)
BOOK_MARKS = (
    "handbook",
    "cambridge",
    "oxford",
    "routledge",
    "nato asi",
    "series",
    "isbn",
    "press",
    "rapid interpretation",
    "principles and practice",
    "current top",
    "edited by",
    "[(]editor",
    "_editor",
)
BOOK = "|".join(BOOK_MARKS)
CHILD_MARKS = (
    ("expression_of_concern", ("expression[ _-]?of[ _-]?concern",)),
    ("retraction", ("retraction", "retracted")),
    ("erratum", ("erratum", "errata")),
    ("corrigendum", ("corrigendum",)),
    ("correction", ("correction", "corrected")),
    ("addendum", ("addendum",)),
    ("appendix", ("appendix", "appendices")),
    ("supplement", ("supplement", "_supp", "-supp", "mmc[0-9]", "supporting")),
)
CHILD = [(kind, "|".join(marks)) for kind, marks in CHILD_MARKS]


def kind_of_name(name: Column) -> Column:
    """The kind of document that a file name tells of."""
    low = F.lower(name)
    book = low.rlike(BOOK)
    dated = low.rlike("[-_](19|20)[0-9]{2}[-_][a-z]")
    return (
        F.when(low.rlike(SUPPLEMENT), "supplement")
        .when(low.rlike("thesis|dissertation"), "thesis")
        .when(book & low.contains("chapter"), "book_chapter")
        .when(book & low.contains("editor"), "edited_volume")
        .when(book, "book")
        .when(low.rlike("poster|conference abstract|abstract book"), "poster_or_abstract")
        .when(low.contains("author)") | low.startswith("author"), "other_or_unknown")
        .when(low.rlike("protocol|registered report"), "protocol")
        .when(name.rlike(r"\s-\s.+\((19|20)[0-9]{2}\)"), "book")
        .when(low.contains("review") & dated, "review_article")
        .when(dated, "journal_article")
        .otherwise("other_or_unknown")
    )


def child_kind(name: Column) -> Column:
    """The kind of child document that a file name tells of, or null."""
    low, out = F.lower(name), F.lit(None).cast("string")
    for kind, pattern in reversed(CHILD):
        out = F.when(low.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def sniffed(text: Column) -> Column:
    """The kind of content that the first characters of a text tell of."""
    head, start = F.lower(F.substring(text, 1, 200)), F.regexp_replace(F.substring(text, 1, 200), r"^\s+", "")
    return (
        F.when(F.length(text) == 0, "empty")
        .when(text.startswith("%PDF"), "pdf")
        .when(start.startswith("<!") | head.contains("<html"), "html")
        .when(F.substring(text, 1, 400).contains("Content-Type:"), "mime")
        .when(F.substring(text, 1, 200).contains(",") & F.substring(text, 1, 400).contains("\n"), "csv")
        .when(start.startswith("{") | start.startswith("["), "text_structured")
        .otherwise("text")
    )


def broken_title(title: Column, own_id: Column, surname: Column) -> Column:
    """Why a title looks broken, or null."""
    t = F.trim(F.coalesce(title, F.lit("")))
    low = F.lower(t)
    spaceless = ~t.contains(" ")
    return (
        F.when(t == "", "T1_empty")
        .when(low == F.lower(F.coalesce(own_id, F.lit(""))), "T2_equals_id")
        .when(F.length(low) < 8, "T3_too_short")
        .when(low.rlike(r"\.(pdf|docx?|indd)$"), "T5_file_ext")
        .when(low.rlike("^[0-9]+$"), "T5_pure_digits")
        .when(low == surname, "T6_just_surname")
        .when(spaceless & ~t.contains("_") & t.rlike("^[A-Za-z]+$"), "T4_camel_no_space")
        .when(spaceless & t.contains("_") & (F.length(t) < 60), "T4b_underscored_no_spaces")
    )


def path_problems(path: Column, stem: Column, safe: Column) -> Column:
    """The rules that a path breaks, in order."""
    return F.array_compact(
        F.array(
            F.when(F.length(path) > 240, "full_path_too_long"),
            F.when(F.length(stem) > 100, "stem_too_long"),
            F.when(stem.rlike(r"^[ .]|[ .]$"), "trailing_space_or_dot"),
            F.when(safe != F.lower(stem), "illegal_or_non_normalized_chars"),
            F.when(F.lower(stem).rlike(r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])([.].*)?$"), "windows_reserved_name"),
            F.when(stem.rlike(r"([_-][0-9]{7,})+$"), "timestamp_suffix_chain"),
        )
    )


# Patterns of pages that carry nothing, and of pages that carry something.
HTML_JUNK = (
    r"there was a problem providing the content",
    r"access denied",
    r"403 forbidden",
    r"404 not found",
    r"page not found",
    r"cookie.?consent",
    r"enable cookies",
    r"refused to connect",
    r"service unavailable",
    r"temporarily unavailable",
    r"robot.?check",
    r"captcha",
    r"sign in to continue",
    r"purchase this article",
    r"institutional access",
)
HTML_USEFUL = (
    r"doi\.org/",
    r"supplement",
    r"supplementary",
    r"mmc[0-9]",
    r"supporting information",
    r"appendix",
    r"erratum",
    r"corrigendum",
    r"abstract",
    r"journal",
    r"sciencedirect\.com/science/article",
)
DOI = r"10\.[0-9]{4,9}/[^\s\"'<>]+"


def _hits(low: Column, patterns: tuple[str, ...]) -> Column:
    return sum((low.rlike(p).cast("int") for p in patterns), F.lit(0))


def html_scores(html: Column) -> Column:
    """Counts of the signs that a page carries nothing (``junk``) and that it carries something (``useful``)."""
    low = F.lower(html)
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]{4,300})</title>", 1))
    named = (F.length(title) >= 8) & ~F.lower(title).rlike("error|denied|cookie|sign in")
    useful = _hits(low, HTML_USEFUL) + named.cast("int") + F.when(low.rlike(DOI), 2).otherwise(0)
    return F.struct(_hits(low, HTML_JUNK).alias("junk"), useful.alias("useful"))


def html_class(scores: Column, size: Column, child: Column) -> Column:
    """What a page found beside an article is."""
    return (
        F.when((scores["junk"] >= 2) & (scores["useful"] == 0), "HTML_OR_TEXT_JUNK")
        .when(child, "HTML_OR_TEXT_CHILD_DOCUMENT")
        .when(scores["useful"] >= 1, "HTML_OR_TEXT_REFERENCE")
        .when(size < 200, "HTML_OR_TEXT_JUNK")
        .otherwise("MODEL_RECOVERY_REQUIRED")
    )


def mime_recoverable(value: Column) -> Column:
    """Whether a mail-like wrapper holds something: a PDF, an attachment, a DOI or much text."""
    low = F.lower(value)
    hint = low.rlike(r'application/pdf|filename="\*\.pdf"|filename=\.pdf|content-disposition: attachment|content-type: application/')
    return hint | low.rlike(DOI) | (F.length(F.regexp_replace(value, r"^\s+|\s+$", "")) > 400)


def limited_item(name: Column, title: Column, value: Column, pages: Column, status: Column, can_rate: Column) -> Column:
    """Abstracts and pages of proceedings, kept but not rated: a verdict and its reasons."""
    sample = F.lower(F.regexp_replace(F.concat_ws(" ", name, title, F.substring(value, 1, 12000)), r"\s+", " "))
    dois = F.size(F.regexp_extract_all(F.lower(value), F.lit(r"\bdoi\s*:\s*10\.[0-9]{4,9}/\S+"), F.lit(0)))
    marker = sample.rlike("abstracts /|conference abstracts")
    reasons = F.array_compact(
        F.array(
            F.when(marker, "page_marker"),
            F.when(dois >= 2, "several_dois"),
            F.when(pages <= 2, "few_pages"),
            F.when(status == "INSUFFICIENT_FOR_EVALUATION", "coverage"),
        )
    )
    verdict = (F.size(reasons) > 0) & (marker | (dois >= 2) | F.contains(sample, F.lit("conference abstract"))) & F.coalesce(~can_rate, F.lit(False))
    return F.struct(verdict.alias("limited"), reasons.alias("reasons"))


# The words that show a section.
SECTION_SIGNALS = (
    ("abstract", r"\babstract\b"),
    ("introduction", r"\bintroduction\b"),
    ("methods", r"\b(?:materials?\s+and\s+)?methods?\b"),
    ("results", r"\bresults?\b"),
    ("discussion", r"\bdiscussion\b"),
    ("references", r"\breferences\b"),
)


def section_signals(value: Column) -> Column:
    """The sections that a text shows signs of."""
    return F.array_compact(F.array(*[F.when(F.lower(value).rlike(p), name) for name, p in SECTION_SIGNALS]))


def likely_article(article: Column, reference: Column, kind: Column, name: Column, title: Column) -> Column:
    """Whether signals, type, file name and title speak for a journal article."""
    typed = F.lower(F.coalesce(kind, F.lit(""))).isin("journal_article", "empirical", "review", "meta_analysis")
    named = F.lower(name).rlike(r"\b(journal|psychophysiology|neuroscience|biological psychology)\b")
    titled = (F.coalesce(title, F.lit("")) != "") & (reference == 0)
    return ((article >= 2) & (reference <= 1)) | ((article >= 1) & (typed | named)) | (~named & (article >= 1) & titled)


# Words in a justification that call for a second look, the first one counts.
HIGH_VALUE = ("systematic review", "meta-analysis", "meta analysis", "randomized", "rct", "preregister", "landmark")


def escalation(rating: Column, confidence: Column, justification: Column, omitted: Column, error: Column) -> Column:
    """Why a result should go to the next model; none if it need not."""
    low = F.lower(F.coalesce(justification, F.lit("")))
    sure = F.lower(F.coalesce(confidence, F.lit("medium")))
    word = F.coalesce(*[F.when(F.contains(low, F.lit(w)), w) for w in HIGH_VALUE])
    reasons = F.array_compact(
        F.array(
            F.when(sure.isin("low", "medium"), F.concat(F.lit("confidence="), sure)),
            F.when(F.lower(rating).isin("strong", "adequate"), F.concat(F.lit("borderline_rating="), F.lower(rating))),
            F.when(F.length(low) < 200, "short_justification"),
            F.when(F.exists(omitted, lambda o: F.lower(o).rlike("methods|results|discussion")), "critical_sections_omitted"),
            F.concat(F.lit("high_value_keyword:"), word),
        )
    )
    return F.when(error, F.array(F.lit("validation_failed"))).otherwise(reasons)


def scan_like(pages: Column, size: Column) -> Column:
    """Three pages or more with hardly any text."""
    return (F.coalesce(pages, F.lit(0)) >= 3) & (F.coalesce(size, F.lit(0)) < LEAST)


def expired(moved_at: Column, now: Column, days: int = 14) -> Column:
    """Whether a rejected file has lain there for ``days``."""
    return now >= moved_at + F.make_dt_interval(F.lit(days))


# Types of documents that get no research rating.
NON_RATABLE_TYPES = (
    "book", "edited_volume", "book_chapter", "manual", "product_manual", "dictionary", "reference_document", "report", "thesis",
    "poster_or_abstract", "conference_abstract", "conference_proceedings", "handbook", "non_research_reference", "supplement",
    "supplementary_material", "corrigendum", "erratum", "correction",
)


def non_ratable_type(kind: Column) -> Column:
    """Whether a type, in any spelling, gets no research rating."""
    return F.coalesce(F.translate(F.lower(F.trim(kind)), "- ", "__").isin(*NON_RATABLE_TYPES), F.lit(False))


# Words of sections, of studies, and of reference works.
SECTION_WORDS = ("abstract", "introduction", "method", "result", "discussion", "reference")
STUDY = r"\b(participants|subjects|n\s*=\s*[0-9]+|experiment|study)\b"
MANUAL = r"\b(handbook|manual|dictionary|standard|protocol|guideline|tutorial)\b"
VOLUME = r"\b(book|chapter|atlas)\b"


def article_signals(low: Column, name: Column, identified: Column, pages: Column, size: Column, no_identity: Column) -> Column:
    """Five scores of a document, added up from its text (lower case), its file's name and its identity."""
    yes = lambda test, points: F.when(test, points).otherwise(0)
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in SECTION_WORDS), F.lit(0))
    volume = name.rlike(VOLUME) & ~F.contains(name, F.lit("review paper"))
    return F.struct(
        (yes(hits >= 2, 2) + yes(identified, 1) + yes(pages >= 3, 1)).alias("journal_article_signals"),
        (yes(hits >= 4, 2) + yes(low.rlike(STUDY), 1)).alias("empirical_signals"),
        (yes(name.rlike(MANUAL), 2) + yes(volume, 1)).alias("reference_material_signals"),
        F.lit(0).alias("child_support_signals"),
        (yes(size < 200, 1) + yes(no_identity, 2)).alias("insufficient_evidence_signals"),
    )
