"""What a file beside an article is, and what becomes of one that is to be recovered: ladders whose order decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.titles import first_of

# Endings of office files, of structured texts and of media; words of data beside an article.
OFFICE = (".docx", ".xlsx", ".pptx", ".odt", ".ods", ".odp")
STRUCTURED = (".csv", ".tsv", ".json", ".xml", ".txt", ".rtf")
MEDIA = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".mp3", ".mp4", ".wav", ".avi", ".mov")
OLD_OFFICE = (".doc", ".xls", ".docx", ".xlsx")
DATA = "supplement|mmc|data|dataset|supporting"
# Words that make the title of a child document.
CHILD_TITLES = ("supplement", "supplementary", "erratum", "corrigendum", "addendum", "appendix", "retraction")


def ending(name: Column) -> Column:
    """The last ending of a name with its point, lower case; blank where there is none."""
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def usability(size: Column, kind: Column, valid: Column, pages: Column, text: Column, rendered: Column) -> Column:
    """Whether a file can be read as a PDF: readable, corrupt, other content, or what is wrong (``reason``)."""
    made = lambda state, reason: F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))
    return first_of(
        (
            (made("corrupt", "file_missing"), size.isNull()),
            (made("corrupt", "zero_byte"), size == 0),
            (made("mismatch", "non_pdf_content_requires_classification"), kind != "pdf"),
            (made("corrupt", "file_too_small"), (size < 500) & (pages == 0) & (text < 5)),
            (made("corrupt", "invalid_pdf"), ~valid),
            (made("corrupt", "zero_pages_no_extractable_content"), (pages == 0) & (text < 5) & (size < 8000)),
            (made("readable", ""), (pages > 0) | (text >= 5) | rendered),
            (made("corrupt", "unrenderable_pdf"), F.lit(True)),
        )
    )


def supplement_class(f: dict[str, Column]) -> Column:
    """One of fifteen classes for a file found beside an article.

    ``f`` has kind (what its content looks like), name, size (null: missing), duplicate, child (its name says so),
    state (of :func:`usability`), non_ratable, valid, pages, junk, useful, hinted, text, recoverable and entries.
    """
    kind, end, child = f["kind"], ending(f["name"]), f["child"]
    archive = kind.isin("zip", "rar", "7z")
    structured = kind.isin("csv", "text_structured", "text") | end.isin(*STRUCTURED)
    media, old = (kind == "media") | end.isin(*MEDIA), (kind == "ole") | end.isin(*OLD_OFFICE)
    pdf, html, mime = kind == "pdf", kind == "html", kind == "mime"
    office = archive & end.isin(*OFFICE)
    useful = html & ((f["useful"] >= 1) | child | f["hinted"])
    return first_of(
        (
            ("TRUE_CORRUPT_UNUSABLE", f["size"].isNull() | (f["size"] == 0)),
            ("CONFIRMED_DUPLICATE", f["duplicate"]),
            ("TRUE_CORRUPT_UNUSABLE", pdf & (f["state"] == "corrupt")),
            ("VALID_PDF_CHILD_DOCUMENT", pdf & child),
            ("VALID_PDF_NON_RATABLE_REFERENCE", pdf & f["non_ratable"]),
            ("VALID_PDF_STANDALONE_RESEARCH", pdf & f["valid"] & (f["pages"] >= 1)),
            ("MODEL_RECOVERY_REQUIRED", pdf),
            ("HTML_OR_TEXT_JUNK", html & (f["junk"] >= 2) & (f["useful"] == 0)),
            ("HTML_OR_TEXT_CHILD_DOCUMENT", useful & child),
            ("HTML_OR_TEXT_REFERENCE", useful),
            ("HTML_OR_TEXT_JUNK", html & (f["text"] < 200)),
            ("MODEL_RECOVERY_REQUIRED", html),
            ("MIME_OR_WRAPPER_RECOVERABLE", mime & f["recoverable"]),
            ("MIME_OR_WRAPPER_JUNK", mime),
            ("VALID_NONPDF_CHILD_DOCUMENT", office & child),
            ("VALID_NONPDF_REFERENCE", office),
            ("ARCHIVE_CHILD_DOCUMENT", archive & (child | (f["entries"] > 0))),
            ("MODEL_RECOVERY_REQUIRED", archive),
            ("VALID_NONPDF_DATASET_OR_MEDIA_SUPPLEMENT", structured & (child | F.lower(f["name"]).rlike(DATA))),
            ("VALID_NONPDF_REFERENCE", structured),
            ("VALID_NONPDF_DATASET_OR_MEDIA_SUPPLEMENT", media & child),
            ("MODEL_RECOVERY_REQUIRED", media),
            ("VALID_NONPDF_CHILD_DOCUMENT", old & child),
            ("VALID_NONPDF_REFERENCE", old),
            ("TRUE_CORRUPT_UNUSABLE", f["size"] < 64),
            ("VALID_NONPDF_CHILD_DOCUMENT", child),
            ("MODEL_RECOVERY_REQUIRED", F.lit(True)),
        )
    )


def recovery(f: dict[str, Column], content: Column, disposition: Column) -> Column:
    """What becomes of a file under recovery: a decision (null if open) and the step that took it.

    ``f`` has owner, twins, state, name, child, child_kind, title, non_ratable, valid, size, pages and text; ``content``
    and ``disposition`` are the class of files that are no PDF and what follows from it.
    """
    made = lambda decision, step: F.struct(F.lit(decision).cast("string").alias("decision"), F.lit(step).alias("step"))
    reference, paper = "RECOVERED_NON_RATABLE_REFERENCE_MOVE_TO_STAGING", "RECOVERED_RESEARCH_PAPER_MOVE_TO_STAGING"
    other, title = f["state"] == "mismatch", F.trim(F.coalesce(f["title"], F.lit("")))
    alone = f["child"] & (F.length(title) >= 12) & ~F.lower(title).rlike("|".join(CHILD_TITLES))
    titled = F.length(title) >= 8
    return first_of(
        (
            (made("DELETE_DUPLICATE", "duplicate_check"), f["owner"].isNotNull() | (f["twins"] > 0)),
            (made("DELETE_JUNK", "content_classification"), other & (disposition == "DELETE")),
            (made("CHILD_DOCUMENT_TO_PENDING_PARENT", "non_pdf_child_content"), other & (disposition == "PENDING")),
            (made(reference, "content_classification_staging"), other & (disposition == "STAGING") & (content == "VALID_PDF_NON_RATABLE_REFERENCE")),
            (made(paper, "content_classification_staging"), other & (disposition == "STAGING")),
            (made("DELETE_JUNK", "pdf_usability_check"), f["state"] == "corrupt"),
            (made(reference, "misclassified_child_non_ratable"), alone & f["non_ratable"]),
            (made(paper, "misclassified_child_research"), alone),
            (made("CHILD_DOCUMENT_TO_PENDING_PARENT", "valid_child_document"), f["child"] & (f["state"] == "readable")),
            (made(reference, "deterministic_non_ratable"), titled & f["non_ratable"]),
            (made(paper, "deterministic_research"), titled),
            (made(None, "needs_model"), (f["size"] >= 5000) & (f["pages"] >= 1) & f["valid"]),
            (made("DELETE_JUNK", "junk"), (f["text"] < 80) & (f["size"] < 5000)),
            (made("TECHNICAL_FAILURE_UNRECOVERABLE", "corrupt"), ~f["valid"]),
            (made(None, "needs_model"), F.lit(True)),
        )
    )
