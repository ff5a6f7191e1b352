"""Queries of the intake: files made of documents, their duplicates among owned, staged and held ones, classes and recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import files, gates, identity
from vellum.operators import intake
from vellum.plans.common import View, word

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# Documents as files: the length of a text names the file, so that equal texts make equal files but for their number.
_ENDINGS = [
    "'.pdf'", "'_mmc1.pdf'", "'_manual.pdf'", "'.html'", "'_supplement.html'", "'.eml'", "'.zip'", "'_supp.zip'", "'.pptx'", "'_appendix.docx'", "'.csv'", "'_dataset.csv'", "'.mp4'", "'_erratum.mp4'", "'.doc'", "'_supplement.doc'", "'.bin'", "'_supplement.bin'", "''",
]
_END = "(CASE n_chars % 19 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(_ENDINGS)) + " END)"
_KIND = "(CASE WHEN n_chars % 19 <= 2 THEN 'pdf' WHEN n_chars % 19 <= 4 THEN 'html' WHEN n_chars % 19 = 5 THEN 'mime' WHEN n_chars % 19 <= 9 THEN 'zip' WHEN n_chars % 19 <= 11 THEN 'csv' WHEN n_chars % 19 <= 13 THEN 'media' WHEN n_chars % 19 <= 15 THEN 'ole' ELSE 'unknown' END)"
_BODY = "(CASE WHEN n_chars % 5 = 0 THEN 'Access denied. 403 forbidden. ' WHEN n_chars % 5 = 1 THEN '<title>Notes on sleep</title> journal ' ELSE '' END || coalesce(text, ''))"
_FILE = {
    "key": "doc_id", "name": f"lower({word(1)}) || '_' || doc_id || {_END}", "digest": "SHA<text>SHA", "kind": _KIND, "body": _BODY, "size": "CASE WHEN n_chars % 29 = 7 THEN 0 ELSE n_chars END",
    "pages": "cast(floor(n_chars / 700) AS INT)", "chars": "CASE WHEN n_chars % 23 = 2 THEN 0 ELSE n_chars END", "valid": "n_chars % 17 <> 3", "entries": "cast(n_chars % 2 AS INT)", "title": f"CASE WHEN n_chars % 3 = 0 THEN '' WHEN n_chars % 3 = 1 THEN {word(2)} || ' ' || {word(3)} || ' and more' ELSE 'Supplementary ' || {word(2)} END",
    "non_ratable": "lang = 'de'",
}
STAGED = View("labelled", _FILE, "quality IS NULL OR quality = 0")
OWNED = View("labelled", {"digest": "SHA<text>SHA", "path": "source || '/' || lpad(cast(doc_id AS STRING), 9, '0') || '.pdf'"}, "quality = 1")
DISOWNED = View("labelled", {"path": OWNED.columns["path"]}, "quality = 1 AND toxic = 1")
HELD = View("labelled", {"key": "doc_id", "digest": "SHA<text>SHA", "name": f"upper({word(1)}) || '_' || (doc_id - doc_id % 3) || {_END}"}, "lang = 'es'")

_O = f"WITH {STAGED.sql('f')}, {OWNED.sql('w')}, {DISOWNED.sql('u')}, o AS (SELECT digest, min(path) AS owner FROM w WHERE path NOT IN (SELECT path FROM u) GROUP BY 1), t AS (SELECT digest, count(*) - 1 AS twins FROM f WHERE digest IS NOT NULL GROUP BY 1), d AS MATERIALIZED (SELECT f.*, owner, coalesce(twins, 0) AS twins FROM f LEFT JOIN o ON f.digest = o.digest LEFT JOIN t ON f.digest = t.digest)"


def _duplicates(spark, sf_dir):
    own = intake.owners(OWNED.df(spark, sf_dir), DISOWNED.df(spark, sf_dir), "digest", "path")
    return intake.duplicates(STAGED.df(spark, sf_dir), own, "digest")


@query(_O + " SELECT key, owner, twins, CASE WHEN owner IS NOT NULL OR twins > 0 THEN 'DELETE_DUPLICATE' ELSE 'SKIP' END AS decision, CASE WHEN owner IS NOT NULL THEN 'hash_identical' WHEN twins > 0 THEN 'staging_hash_identical' ELSE 'no_canonical_owner_for_hash' END AS match FROM d")
def x_09(spark, sf_dir):
    """Staged files whose digest has an owner that is not disowned, or else a staged twin (X-07, X-09)."""
    why = F.when(c("owner").isNotNull(), "hash_identical").when(c("twins") > 0, "staging_hash_identical").otherwise("no_canonical_owner_for_hash")
    return _duplicates(spark, sf_dir).select("key", "owner", "twins", F.when(c("duplicate"), "DELETE_DUPLICATE").otherwise("SKIP").alias("decision"), why.alias("match"))


@query(f"WITH {STAGED.sql('f')}, {HELD.sql('h')}, m AS (SELECT f.key AS key, h.key AS held FROM f JOIN h ON f.digest = h.digest UNION ALL SELECT f.key, h.key FROM f JOIN h ON lower(f.name) = lower(h.name) WHERE trim(h.name) <> '') SELECT f.key AS key, min(held) AS pending FROM f LEFT JOIN m ON f.key = m.key GROUP BY 1")
def x_12(spark, sf_dir):
    """The first held file with the digest or the name of a staged one (X-12)."""
    return intake.pending_twin(STAGED.df(spark, sf_dir).select("key", "digest", "name"), HELD.df(spark, sf_dir), "key", "digest", "name").select("key", "pending")


_CHILD = "regexp_matches(lower(name), 'expression[ _-]?of[ _-]?concern|retraction|retracted|erratum|errata|corrigendum|correction|corrected|addendum|appendix|appendices|supplement|_supp|-supp|mmc[0-9]|supporting')"
_S = _O + rf""", e AS MATERIALIZED (SELECT *, {_CHILD} AS child, lower(regexp_extract(name, '[^.](\.[^.]+)$', 1)) AS ext, lower(body) AS low, trim(regexp_extract(body, '(?is)<title[^>]*>([^<]{{4,300}})</title>', 1)) AS head,
  CASE WHEN size = 0 THEN 'corrupt' WHEN kind <> 'pdf' THEN 'mismatch' WHEN (size < 500 AND pages = 0 AND chars < 5) OR NOT valid OR (pages = 0 AND chars < 5 AND size < 8000) THEN 'corrupt' WHEN pages > 0 OR chars >= 5 THEN 'readable' ELSE 'corrupt' END AS state FROM d),
h AS MATERIALIZED (SELECT *, regexp_matches(low, 'there was a problem providing the content')::INT + contains(low, 'access denied')::INT + contains(low, '403 forbidden')::INT + contains(low, '404 not found')::INT + contains(low, 'page not found')::INT + regexp_matches(low, 'cookie.?consent')::INT
  + contains(low, 'enable cookies')::INT + contains(low, 'refused to connect')::INT + contains(low, 'service unavailable')::INT + contains(low, 'temporarily unavailable')::INT + regexp_matches(low, 'robot.?check')::INT + contains(low, 'captcha')::INT + contains(low, 'sign in to continue')::INT
  + contains(low, 'purchase this article')::INT + contains(low, 'institutional access')::INT AS junk,
  contains(low, 'doi.org/')::INT + contains(low, 'supplement')::INT + contains(low, 'supplementary')::INT + regexp_matches(low, 'mmc[0-9]')::INT + contains(low, 'supporting information')::INT + contains(low, 'appendix')::INT + contains(low, 'erratum')::INT + contains(low, 'corrigendum')::INT
  + contains(low, 'abstract')::INT + contains(low, 'journal')::INT + contains(low, 'sciencedirect.com/science/article')::INT + (length(head) >= 8 AND NOT regexp_matches(lower(head), 'error|denied|cookie|sign in'))::INT + CASE WHEN regexp_matches(low, '10\.[0-9]{{4,9}}/[^\s"''<>]+') THEN 2 ELSE 0 END AS useful,
  contains(low, 'application/pdf') OR contains(low, 'filename="*.pdf"') OR contains(low, 'filename=.pdf') OR contains(low, 'content-disposition: attachment') OR contains(low, 'content-type: application/') OR regexp_matches(low, '10\.[0-9]{{4,9}}/[^\s"''<>]+') OR length(regexp_replace(body, '^\s+|\s+$', '', 'g')) > 400 AS recoverable FROM e),
k AS MATERIALIZED (SELECT *, CASE WHEN size = 0 THEN 'TRUE_CORRUPT_UNUSABLE' WHEN owner IS NOT NULL OR twins > 0 THEN 'CONFIRMED_DUPLICATE'
  WHEN kind = 'pdf' THEN CASE WHEN state = 'corrupt' THEN 'TRUE_CORRUPT_UNUSABLE' WHEN child THEN 'VALID_PDF_CHILD_DOCUMENT' WHEN non_ratable THEN 'VALID_PDF_NON_RATABLE_REFERENCE' WHEN valid AND pages >= 1 THEN 'VALID_PDF_STANDALONE_RESEARCH' ELSE 'MODEL_RECOVERY_REQUIRED' END
  WHEN kind = 'html' THEN CASE WHEN junk >= 2 AND useful = 0 THEN 'HTML_OR_TEXT_JUNK' WHEN child THEN 'HTML_OR_TEXT_CHILD_DOCUMENT' WHEN useful >= 1 THEN 'HTML_OR_TEXT_REFERENCE' WHEN chars < 200 THEN 'HTML_OR_TEXT_JUNK' ELSE 'MODEL_RECOVERY_REQUIRED' END
  WHEN kind = 'mime' THEN CASE WHEN recoverable THEN 'MIME_OR_WRAPPER_RECOVERABLE' ELSE 'MIME_OR_WRAPPER_JUNK' END
  WHEN kind = 'zip' THEN CASE WHEN ext IN ('.docx', '.pptx') THEN CASE WHEN child THEN 'VALID_NONPDF_CHILD_DOCUMENT' ELSE 'VALID_NONPDF_REFERENCE' END WHEN child OR entries > 0 THEN 'ARCHIVE_CHILD_DOCUMENT' ELSE 'MODEL_RECOVERY_REQUIRED' END
  WHEN kind = 'csv' THEN CASE WHEN child OR regexp_matches(lower(name), 'supplement|mmc|data|dataset|supporting') THEN 'VALID_NONPDF_DATASET_OR_MEDIA_SUPPLEMENT' ELSE 'VALID_NONPDF_REFERENCE' END
  WHEN kind = 'media' THEN CASE WHEN child THEN 'VALID_NONPDF_DATASET_OR_MEDIA_SUPPLEMENT' ELSE 'MODEL_RECOVERY_REQUIRED' END WHEN kind = 'ole' THEN CASE WHEN child THEN 'VALID_NONPDF_CHILD_DOCUMENT' ELSE 'VALID_NONPDF_REFERENCE' END
  WHEN size < 64 THEN 'TRUE_CORRUPT_UNUSABLE' WHEN child THEN 'VALID_NONPDF_CHILD_DOCUMENT' ELSE 'MODEL_RECOVERY_REQUIRED' END AS class FROM h)"""


def _classified(spark, sf_dir):
    d = _duplicates(spark, sf_dir)
    child = gates.child_kind(c("name")).isNotNull()
    d = d.withColumns({"s": gates.html_scores(c("body")), "recoverable": gates.mime_recoverable(c("body")), "child": child})
    d = d.withColumn("state", files.usability(c("size"), c("kind"), c("valid"), c("pages"), c("chars"), F.lit(False))["state"]).drop("body")
    facts = {k: c(k) for k in ("kind", "name", "size", "duplicate", "child", "state", "non_ratable", "valid", "pages", "recoverable", "entries")}
    facts |= {"junk": c("s.junk"), "useful": c("s.useful"), "hinted": F.lit(False), "text": c("chars")}
    return d.withColumn("class", files.supplement_class(facts))


@query(_S + " SELECT key, class, state FROM k")
def c_09(spark, sf_dir):
    """Fifteen classes of files beside an article (C-09): duplicates by digest first, then the content, then the name."""
    return _classified(spark, sf_dir).select("key", "class", "state")


@query(_S + """, a AS (SELECT *, CASE WHEN class IN ('CONFIRMED_DUPLICATE', 'TRUE_CORRUPT_UNUSABLE', 'HTML_OR_TEXT_JUNK', 'MIME_OR_WRAPPER_JUNK') THEN 'DELETE' WHEN class IN ('VALID_PDF_STANDALONE_RESEARCH', 'VALID_PDF_NON_RATABLE_REFERENCE', 'VALID_NONPDF_REFERENCE', 'HTML_OR_TEXT_REFERENCE') THEN 'STAGING' ELSE 'PENDING' END AS fate,
  child AND length(title) >= 12 AND NOT regexp_matches(lower(title), 'supplement|supplementary|erratum|corrigendum|addendum|appendix|retraction') AS alone FROM k),
b AS (SELECT key, class, CASE WHEN owner IS NOT NULL OR twins > 0 THEN ['DELETE_DUPLICATE', 'duplicate_check'] WHEN state = 'mismatch' AND fate = 'DELETE' THEN ['DELETE_JUNK', 'content_classification'] WHEN state = 'mismatch' AND fate = 'PENDING' THEN ['CHILD_DOCUMENT_TO_PENDING_PARENT', 'non_pdf_child_content']
  WHEN state = 'mismatch' THEN ['RECOVERED_RESEARCH_PAPER_MOVE_TO_STAGING', 'content_classification_staging'] WHEN state = 'corrupt' THEN ['DELETE_JUNK', 'pdf_usability_check']
  WHEN alone AND non_ratable THEN ['RECOVERED_NON_RATABLE_REFERENCE_MOVE_TO_STAGING', 'misclassified_child_non_ratable'] WHEN alone THEN ['RECOVERED_RESEARCH_PAPER_MOVE_TO_STAGING', 'misclassified_child_research'] WHEN child THEN ['CHILD_DOCUMENT_TO_PENDING_PARENT', 'valid_child_document']
  WHEN length(title) >= 8 AND non_ratable THEN ['RECOVERED_NON_RATABLE_REFERENCE_MOVE_TO_STAGING', 'deterministic_non_ratable'] WHEN length(title) >= 8 THEN ['RECOVERED_RESEARCH_PAPER_MOVE_TO_STAGING', 'deterministic_research'] WHEN size >= 5000 AND pages >= 1 THEN [NULL, 'needs_model'] WHEN chars < 80 AND size < 5000 THEN ['DELETE_JUNK', 'junk'] ELSE [NULL, 'needs_model'] END AS x FROM a)
SELECT key, class, x[1] AS decision, x[2] AS step FROM b""")
def c_27(spark, sf_dir):
    """What becomes of files under recovery (C-27), from their duplicates, classes, readability, names and titles; null where a model would decide."""
    k = _classified(spark, sf_dir)
    facts = {n: c(n) for n in ("owner", "twins", "state", "name", "child", "title", "non_ratable", "valid", "size", "pages")} | {"text": c("chars")}
    made = files.recovery(facts, c("class"), identity.disposition(c("class")))
    return k.select("key", "class", made.alias("r")).select("key", "class", "r.*")
