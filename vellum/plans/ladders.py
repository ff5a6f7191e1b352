"""Ladders over titles, identities and contents: each is a CASE whose order decides. Their SQL is written apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import contents, gates, titles
from vellum.plans.common import View, sql_norm, word
from vellum.plans.papers import MAIN

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Titles as catalogues hold them: the head of the text for most, and for the rest what else is found in their place, around words of the text.
_HEAD = "substring(split_part(coalesce(text, ''), chr(10), 1), 1, 120)"
_FOUND = [
    "''", "' Untitled '", word(1), f"substring({word(1)}, 1, 4)", "'PII: S0301-0511(05)' || lpad(cast(doc_id AS STRING), 5, '0')", "'S0301-0511(05)' || lpad(cast(doc_id AS STRING), 5, '0')",
    "'10.1016/j.x.' || doc_id", f"'doi:10.1016/x.' || doc_id || ' ' || {word(1)}", "'ISSN 0301-051' || doc_id % 10", f"'(c) 2005 ' || {word(1)} || ' press'", f"'Volume 12 ' || {word(2)}", f"'Neuroscience Letters ' || {word(2)}",
    f"'NOTES OF THE EDITORS AND OTHERS ON S0301-0511(05)00012 ' || upper({word(2)})", f"{word(1)} || ' of unknown  PII and other matters of the same kind'", f"{word(1)} || ' and the rest pii s12'", f"'On a pii of ' || {word(2)}",
    f"'Author (' || {word(1)} || ') and others'", f"'The Journal of ' || {word(1)} || ' studies'", f"'The new old Journal of ' || {word(2)}", f"{word(1)} || ' notes.docx of the year'", f"{word(1)} || ' notes 12'", f"{word(1)} || ' ' || {word(2)} || ' la vie de'",
    "substring(coalesce(text, ''), 1, 200)",
]
_TITLE = "(CASE n_chars % 46 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(_FOUND)) + f" ELSE {_HEAD} END)"
# Rows of the catalogue with such titles; some ids and files are named by a publisher's number, some names of files hold a title.
ROWS = View(
    "labelled",
    MAIN.columns
    | {
        "doc": "doc_id",
        "title": _TITLE,
        "id": f"CASE n_chars % 11 WHEN 3 THEN 'Unknown_PII_' || doc_id WHEN 5 THEN {word(1)} || '_' || lower({word(2)}) || '_' || lower({word(3)}) || '_' || doc_id || '_b' ELSE {MAIN.columns['id']} END",
        "renamed": f"CASE n_chars % 13 WHEN 1 THEN 'unknown_pii_' || doc_id || '.pdf' WHEN 2 THEN 'manual of ' || doc_id || '.pdf' ELSE {MAIN.columns['renamed']} END",
        "original": f"CASE n_chars % 3 WHEN 0 THEN {word(1)} || ' - ' || {word(2)} || '_' || {word(3)} || ' ' || {word(4)} || '-2005-' || {word(5)} || '.pdf' WHEN 1 THEN {word(1)} || '-' || {word(2)} || ' ' || {word(3)} || '_20050101.pdf' ELSE {MAIN.columns['original']} END",
        "pii": f"CASE WHEN n_chars % 5 = 0 THEN {word(1)} ELSE '' END",
        "rating": f"CASE n_chars % 7 WHEN 1 THEN 'not_applicable' WHEN 2 THEN 'not_ratable_reference_material' ELSE {MAIN.columns['rating']} END",
        "flagged": "coalesce(toxic = 1, false)",
        "resolved": "doc_id % 19 = 0",
        "article": "cast(n_chars % 4 AS INT)",
        "reference": "cast(floor(n_chars % 6 / 2) AS INT)",
        "first_line": "split_part(coalesce(text, ''), chr(10), 1)",
        "chain": "CASE lang WHEN 'fr' THEN 'crossref' WHEN 'de' THEN 'pdf_embed' WHEN 'es' THEN 'filename_human' ELSE '' END",
    },
)
R = f"WITH {ROWS.sql('r')}"


def rows(spark, sf_dir):
    return ROWS.df(spark, sf_dir)


def _sql_problem(title: str) -> str:
    """The ladder of titles in SQL, on a text that may be null."""
    t = rf"trim(regexp_replace(coalesce({title}, ''), '\s+', ' ', 'g'))"
    number = r"\bs?[0-9]{4}[-–][0-9]{4}\([0-9]{2}\)[0-9]{5}[-–]?[0-9]*\b"
    return rf"""list_transform([{t}], lambda t: CASE WHEN t = '' THEN 'empty' WHEN lower(t) IN ('untitled', 'unknown', 'no title', 'document', 'microsoft word', 'download', 'exact paper title') THEN 'junk_literal'
  WHEN length(t) < 8 AND length(t) >= 5 AND regexp_full_match(t, '[A-Za-z][A-Za-z''-]{{3,}}') THEN NULL WHEN length(t) < 8 THEN 'too_short' WHEN regexp_matches(lower(t), '^pii\s*:') THEN 'pii_prefix'
  WHEN regexp_full_match(replace(lower(t), ' ', ''), '{number}') OR (regexp_matches(lower(t), '{number}') AND length(t) < 40) THEN 'pii_value'
  WHEN regexp_full_match(t, '10\.[0-9]{{4,9}}/[^\s\])>"'']+') OR (starts_with(lower(t), 'doi:') AND regexp_matches(t, '\b10\.[0-9]{{4,9}}/[^\s\])>"'']+')) THEN 'doi_only'
  WHEN regexp_matches(lower(t), '\bissn[:\s-]*[0-9]{{4}}[-–]?[0-9]{{3,4}}[x0-9]?\b') AND length(t) < 30 THEN 'issn_only' WHEN regexp_matches(lower(t), '©|copyright|\(c\)\s*[0-9]{{4}}') AND length(t) < 80 THEN 'copyright_line'
  WHEN regexp_matches(lower(t), '^(vol\.|volume|issue|page|pp\.)\b') THEN 'issue_metadata'
  WHEN regexp_matches(lower(t), '^(psychophysiology|biological psychology|neuroscience letters)\b') AND length(t) < 40 AND NOT contains(lower(t), ' in ') AND NOT contains(lower(t), ' of ') AND NOT contains(t, ':') THEN 'journal_header_only'
  WHEN regexp_full_match(t, '[A-Z0-9\s–().,/-]+') AND regexp_matches(lower(t), '{number}') THEN 'pii_caps_header' WHEN regexp_matches(lower(t), '\bunknown\s+pii\b') THEN 'unknown_pii_title' WHEN regexp_matches(lower(t), '\bpii\s*s?[0-9]*$') THEN 'pii_derived_title'
  WHEN regexp_matches(lower(t), '\bpii\b') AND length(t) < 48 AND NOT regexp_matches(lower(t), 'polygraph|symposium') THEN 'pii_token_in_title' WHEN regexp_matches(lower(t), '^author\s*\(') THEN 'author_line_not_title'
  WHEN regexp_matches(lower(t), '^(international|the)\s+journal\s+of\b') OR regexp_matches(lower(t), '^the\s+(?:[a-z]+\s+){{0,3}}journal\s+of\b') THEN 'journal_header_not_title' WHEN regexp_matches(lower(t), '\.(pdf|docx?|pptx?)\b') THEN 'filename_extension_artifact'
  WHEN regexp_matches(lower(t), '\b[0-9]{{1,3}}$') AND len(regexp_extract_all(t, '[a-zA-Z]{{2,}}')) <= 3 AND length(t) < 45 THEN 'trailing_numeric_fragment'
  WHEN lower(coalesce(list_last(regexp_extract_all(t, '[A-Za-z]+')), '')) IN ('de', 'da', 'di', 'du', 'fo') AND length(t) < 80 THEN 'dangling_title_fragment' END)[1]"""


def _sql_name_title(name: str) -> str:
    plain = rf"trim(regexp_replace(replace(regexp_replace(regexp_replace({name}, '\.[^.]*$', ''), '(?:_[0-9]{{7,}})+', ' ', 'g'), '_', ' '), '\s+', ' ', 'g'))"
    cut = rf"trim(regexp_replace(trim(CASE WHEN contains({plain}, ' - ') THEN substring({plain}, instr({plain}, ' - ') + 3) ELSE regexp_replace({plain}, '^[A-Za-z]+-', '') END), '-[0-9]{{4}}-[A-Za-z]{{2,12}}$', ''))"
    return f"CASE WHEN length({cut}) >= 12 AND {_sql_problem(cut)} IS NULL THEN {cut} END"


# One pass makes what the ladders below share.
_Q = f"""{R}, n AS MATERIALIZED (SELECT *, {_sql_problem('title')} AS problem, {_sql_name_title('original')} AS original_title, {_sql_name_title('renamed')} AS renamed_title FROM r),
s AS MATERIALIZED (SELECT *, coalesce(lower(title), '') AS low, regexp_matches(lower(id), '(^|_)pii($|_)|unknown_pii|_pii_') AS bad_id, regexp_matches(lower(renamed), '(^|_)pii($|_)|unknown_pii|_pii_') AS bad_name, contains(lower(renamed), 'pii') AS pii_name, coalesce(rating, '') AS rated FROM n),
g AS MATERIALIZED (SELECT *, CASE WHEN resolved THEN [] ELSE list_filter([CASE WHEN trim(title) = '' THEN 'empty_title' WHEN starts_with(upper(title), 'PII:') THEN 'pii_prefix_title' WHEN problem IS NOT NULL THEN 'invalid_title:' || problem END,
  CASE WHEN bad_id THEN 'poisoned_paper_id' END, CASE WHEN pii_name THEN 'poisoned_source_filename' END, CASE WHEN pii <> '' AND trim(title) <> '' AND contains(trim(low), lower(trim(pii))) THEN 'title_contains_stored_pii' END,
  CASE WHEN original <> '' AND renamed <> '' AND original_title IS NOT NULL THEN CASE WHEN problem IS NOT NULL OR starts_with(upper(title), 'PII:') THEN 'filename_has_better_title' WHEN substring(lower(original_title), 1, 20) <> substring(low, 1, 20) AND bad_name THEN 'title_filename_identity_mismatch' END END,
  CASE WHEN rated IN ('not_applicable', 'not_ratable_reference_material') THEN 'suspicious_rating:' || rated END, CASE WHEN flagged THEN 'prior_guard_or_reeval_flag' END,
  CASE WHEN starts_with(rated, 'not_') AND NOT coalesce(survived, false) AND chars >= 2000 THEN 'red_team_skipped_with_substantial_text' END], lambda x: x IS NOT NULL) END AS signs,
  CASE WHEN coalesce(kind, '') IN ('book', 'book_chapter', 'handbook', 'manual') THEN true WHEN regexp_matches(lower(renamed), '\\b(handbook|manual|standard|as[_-]?nzs|checklist|guideline|protocol)\\b') THEN reference >= article ELSE reference >= 2 AND article <= 1 END AS genuine FROM s)"""


@query(f"{R} SELECT doc, {_sql_problem('title')} AS problem FROM r")
def flt_17(spark, sf_dir):
    """Why a text cannot stand as a title: twenty rules in order (FLT-17)."""
    return rows(spark, sf_dir).select("doc", titles.title_problem(c("title")).alias("problem"))


def _signs():
    return titles.poison_signals({k: c(k) for k in ("id", "title", "renamed", "original", "pii", "rating", "flagged", "survived", "chars", "resolved")})


@query(_Q + " SELECT doc, array_to_string(signs, ',') AS signs FROM g")
def flt_21(spark, sf_dir):
    """All signs of a spoilt identity (FLT-21); names of files give titles by their plain words."""
    return rows(spark, sf_dir).select("doc", F.array_join(_signs(), ",").alias("signs"))


_OWNER = "CASE WHEN renamed = '' THEN 'missing_source_pdf' WHEN n_owners > 1 THEN 'ambiguous' ELSE 'owned' END"


@query(_Q + f""", o AS (SELECT renamed AS file, count(*) AS n_owners FROM g WHERE renamed <> '' GROUP BY 1),
i AS (SELECT *, regexp_extract(regexp_replace(id, '_b$', ''), '^[^_]*_(.*)$', 1) AS rest FROM g), j AS (SELECT *, trim(replace(rest, '_', ' ')) AS of_id FROM i),
k AS (SELECT j.*, {_OWNER} AS owner, [t for t in [{{'source': 'filename_original_filename', 'title': original_title, 'sure': 0.75}}, {{'source': 'filename_renamed_filename', 'title': renamed_title, 'sure': 0.75}},
  {{'source': 'paper_id_derived', 'title': CASE WHEN lower(rest) <> 'pii' AND NOT ends_with(lower(rest), '_pii') AND length(of_id) >= 12 THEN of_id END, 'sure': 0.65}},
  {{'source': 'first_page_heuristic', 'title': trim(regexp_replace(first_line, '\\s+', ' ', 'g')), 'sure': 0.7}}] if t.title <> ''] AS found FROM j LEFT JOIN o ON renamed = file),
l AS (SELECT *, CASE WHEN problem IS NULL THEN {{'source': 'existing_valid_title', 'title': title, 'sure': 1.0}} ELSE list_reduce(list_prepend(NULL, [x for x in found if {_sql_problem('x.title')} IS NULL]), lambda a, b: CASE WHEN a IS NULL OR b.sure > a.sure THEN b ELSE a END) END AS repair FROM k),
m AS (SELECT *, len(list_filter(signs, lambda s: regexp_matches(s, '^(pii_|invalid_title|empty_title|poisoned_|title_filename)'))) > 0 AS spoilt, rated IN ('not_applicable', 'not_ratable_reference_material') AND len(list_filter(signs, lambda s: starts_with(s, 'suspicious_rating'))) > 0 AS suspicious,
  problem IS NOT NULL AS retitle, repair IS NULL AS none, list_contains(signs, 'poisoned_source_filename') AS bad_file, coalesce(repair.sure, 0) AS sure FROM l),
v AS (SELECT doc, repair.title AS new_title, CASE WHEN owner <> 'owned' THEN ['source_ownership_problem', owner, '0'] WHEN pii <> '' AND NOT spoilt AND NOT bad_id AND NOT pii_name THEN ['already_valid_identifier_only', 'pii_stored_as_identifier', '1']
  WHEN none AND spoilt THEN ['uncertain_manual_review', 'no_deterministic_title_recovery', '0'] WHEN none AND suspicious AND genuine THEN ['already_valid_identifier_only', 'genuine_reference_material', '0.9'] WHEN none AND suspicious AND article >= 2 THEN ['mark_for_reevaluation', 'journal_article_suspicious_rating', '0.85']
  WHEN none THEN ['already_valid_identifier_only', 'no_repair_needed', '1'] WHEN retitle AND sure < 0.65 THEN ['uncertain_manual_review', 'title_recovery_confidence_too_low', sure::VARCHAR] WHEN retitle THEN ['deterministic_repair_safe', 'deterministic_identity_recovery', sure::VARCHAR]
  WHEN bad_id OR bad_file THEN ['deterministic_repair_safe', 'deterministic_identity_recovery', greatest(sure, 0.9)::VARCHAR] WHEN starts_with(rated, 'not_') AND NOT genuine AND article >= 2 THEN ['mark_for_reevaluation', 'poisoned_classification_journal_article', '0.8']
  WHEN spoilt THEN ['uncertain_manual_review', 'insufficient_confidence_for_auto_repair', '0'] ELSE ['already_valid_identifier_only', 'stable', '1'] END AS b FROM m)
SELECT doc, b[1] AS bucket, b[2] AS reason, b[3]::DOUBLE AS confidence, new_title FROM v""")
def c_29(spark, sf_dir):
    """What is to be done with rows of spoilt identity, and the title to put in (C-29, X-22): files with several owners first, by a count per file."""
    r = rows(spark, sf_dir)
    owners = r.filter("renamed <> ''").groupBy(c("renamed").alias("file")).agg(F.count("*").alias("n_owners"))
    r = r.join(owners, c("renamed") == c("file"), "left").withColumn("owner", F.expr(_OWNER)).withColumn("signs", _signs())
    others = titles.candidates(
        ("filename_original_filename", titles.name_title(c("original")), 0.75), ("filename_renamed_filename", titles.name_title(c("renamed")), 0.75), ("paper_id_derived", titles.id_title(c("id")), 0.65), ("first_page_heuristic", c("first_line"), 0.7)
    )
    own = titles.candidates(("existing_valid_title", c("title"), 1.0))
    r = r.withColumn("repair", titles.surest(F.when(titles.title_problem(c("title")).isNull(), own).otherwise(others)))
    genuine = titles.reference_work(c("kind"), c("renamed"), c("article"), c("reference"))
    made = titles.repair_bucket({k: c(k) for k in ("id", "title", "rating", "pii", "renamed")}, c("signs"), c("owner"), c("repair"), c("article"), genuine)
    kept = F.when(c("repair.source") == "existing_valid_title", c("title")).otherwise(c("repair.title"))
    return r.select("doc", made.alias("b"), kept.alias("new_title")).select("doc", "b.*", "new_title")


@query(_Q + """ SELECT doc, CASE WHEN x[1] THEN 'confirm_not_applicable' WHEN x[2] OR genuine OR coalesce(kind, '') IN ('book', 'book_chapter', 'supplement', 'thesis') THEN 'confirm_non_ratable' WHEN x[3] AND article >= 2 AND reference <= 1 AND chars >= 200 THEN 'sonnet_evaluate'
  WHEN x[3] THEN 'confirm_not_applicable' WHEN flagged AND chars >= 200 THEN 'sonnet_evaluate' WHEN flagged THEN 'confirm_not_applicable' ELSE 'already_complete' END AS action,
  CASE WHEN x[1] THEN 'title_or_filename_editorial_or_supplement' WHEN x[2] THEN 'title_or_filename_reference_material' WHEN genuine THEN 'reference_material_signals' WHEN coalesce(kind, '') IN ('book', 'book_chapter', 'supplement', 'thesis') THEN 'corpus_classifier'
  WHEN x[3] AND article >= 2 AND reference <= 1 THEN CASE WHEN chars >= 200 THEN 'journal_article_signals_with_suspicious_rating' ELSE 'insufficient_text_for_research_eval' END WHEN x[3] THEN 'retain_non_research_classification'
  WHEN flagged THEN CASE WHEN chars >= 200 THEN 'explicit_reevaluation_flag' ELSE 'reevaluation_flag_but_insufficient_text' END ELSE 'no_action_needed' END AS reason
FROM (SELECT *, [regexp_matches(low, 'last word from|supplementary material|supplement for|reply to|committee report|osf prereg|panel discussion|copyediting specification|abstracts [0-9]{4}|^erratum to |^corrigendum to ')
    OR regexp_matches(lower(renamed), 'last word from|supplementary material|supplement for|reply to|committee report|osf prereg|panel discussion|copyediting specification|abstracts [0-9]{4}|^erratum to |^corrigendum to '),
  regexp_matches(low || chr(10) || lower(renamed), 'springerbriefs|media effects:|treating attachment disorders|eye movement research: an introduction|designing experiments and analyzing data|for dummies|user manual|guideline thirteen|product manual|handbook of |edited volume|second edition|model comparison perspective|physiology of the autonomic nervous system|complete reference guide to the elsevier'),
  rated IN ('not_applicable', 'not_ratable_reference_material')] AS x FROM g)""")
def c_30(spark, sf_dir):
    """What a row needs before it counts as done (C-30); the kind of the row stands for the classifier of names."""
    genuine = titles.reference_work(c("kind"), c("renamed"), c("article"), c("reference"))
    made = titles.readiness({k: c(k) for k in ("title", "renamed", "rating", "chars", "flagged")}, c("article"), c("reference"), genuine, gates.non_ratable_type(c("kind")))
    return rows(spark, sf_dir).select("doc", made.alias("a")).select("doc", "a.*")


_USABLE = "length(trim(regexp_replace({0}, '\\s+', ' ', 'g'))) >= 12 AND len(list_filter(string_split(authors, ';'), lambda a: length(trim(a)) > 2)) > 0 AND (coalesce(CASE WHEN regexp_matches(trim(year), '^[0-9]{{4}}$') THEN trim(year)::INT BETWEEN 1950 AND 2035 END, false) OR length(trim(coalesce(doi, ''))) >= 8{1})"


@query(_Q + f""", d AS (SELECT trim(doi) AS key, min(title) AS doi_title FROM g WHERE trim(coalesce(doi, '')) <> '' AND trim(title) <> '' GROUP BY 1),
f AS (SELECT g.*, [t for t in [{{'source': 'metadata_chain', 'title': trim(regexp_replace(title, '\\s+', ' ', 'g')), 'sure': CASE WHEN lang_ok THEN 0.7 ELSE 0.4 END}}, {{'source': 'filename_human', 'title': original_title, 'sure': 0.55}}, {{'source': 'crossref', 'title': trim(regexp_replace(doi_title, '\\s+', ' ', 'g')), 'sure': 0.95}},
  {{'source': 'pdf_embed', 'title': trim(regexp_replace(substring(abstract, 1, 60), '\\s+', ' ', 'g')), 'sure': 0.6}}, {{'source': 'first_page_heuristic', 'title': trim(regexp_replace(first_line, '\\s+', ' ', 'g')), 'sure': 0.45}}] if t.title <> ''] AS found FROM (SELECT *, chain <> 'filename_human' AS lang_ok FROM g) g LEFT JOIN d ON trim(doi) = key),
b AS (SELECT *, list_reduce(list_prepend(NULL, list_sort([{{'less': -x.sure, 'place': list_position([lower(y.title) for y in found], lower(x.title)), 'source': x.source, 'title': x.title, 'sure': x.sure}} for x in found if {_sql_problem('x.title')} IS NULL])), lambda a, z: CASE WHEN a IS NULL THEN z ELSE a END) AS best FROM f),
e AS (SELECT *, CASE WHEN best.source = 'metadata_chain' AND chain <> '' THEN chain ELSE best.source END AS named FROM b),
h AS (SELECT *, CASE WHEN best IS NULL THEN 'insufficient_identity' WHEN starts_with(named, 'filename') THEN 'recovered_from_filename' WHEN named = 'first_page_heuristic' THEN 'recovered_from_first_page' WHEN named IN ('pdf_embed', 'crossref') THEN 'recovered_from_' || named WHEN best.sure < 0.5 THEN 'insufficient_identity' ELSE 'high_confidence' END AS won FROM e)
SELECT doc, best.title AS chosen, best.source AS source, won AS status, CASE WHEN {_sql_problem('best.title')} IS NOT NULL THEN {_sql_problem('best.title')} WHEN won = 'insufficient_identity' THEN CASE WHEN {_USABLE.format("coalesce(best.title, '')", '')} THEN NULL ELSE 'insufficient_identity' END
  WHEN (starts_with(best.source, 'filename') OR chain IN ('pdf_embed', 'filename_human') OR won IN ('recovered_from_filename', 'recovered_from_pdf_embed', 'recovered_from_first_page')) AND coalesce(doi, '') = '' AND len(regexp_extract_all(best.title, '[A-Za-z][A-Za-z''-]{{2,}}')) < 4 THEN 'weak_identity_title_fragment'
  WHEN (starts_with(best.source, 'filename') OR chain IN ('pdf_embed', 'filename_human') OR won IN ('recovered_from_filename', 'recovered_from_pdf_embed', 'recovered_from_first_page')) AND coalesce(doi, '') = '' AND coalesce(year, '') = '' AND coalesce(journal, '') = '' AND len(regexp_extract_all(best.title, '[A-Za-z][A-Za-z''-]{{2,}}')) < 5 THEN 'weak_identity_lacks_bibliographic_anchor' END AS problem FROM h""")
def c_18(spark, sf_dir):
    """The title, its source and the status of an identity, and why it is too weak (C-18): five sources a row, held in the row; the records by DOI come by a join."""
    r = rows(spark, sf_dir)
    known = r.filter("trim(coalesce(doi, '')) <> '' AND trim(title) <> ''").groupBy(F.trim("doi").alias("key")).agg(F.min("title").alias("doi_title"))
    r = r.join(known, F.trim("doi") == c("key"), "left")
    found = titles.candidates(
        ("metadata_chain", c("title"), 0.7), ("filename_human", titles.name_title(c("original")), 0.55), ("crossref", c("doi_title"), 0.95), ("pdf_embed", F.substring("abstract", 1, 60), 0.6), ("first_page_heuristic", c("first_line"), 0.45)
    )
    less = F.transform(found, lambda x: x.withField("confidence", F.when((x["source"] == "metadata_chain") & (c("chain") == "filename_human"), 0.4).otherwise(x["confidence"])))
    r = r.withColumn("best", titles.surest(less)).withColumn("status", titles.identity_status(c("best"), c("chain")))
    problem = titles.identity_problem(c("best.title"), c("best.source"), c("chain"), c("status"), F.split("authors", ";"), c("year"), c("doi"), c("journal"))
    return r.select("doc", c("best.title").alias("chosen"), c("best.source").alias("source"), "status", problem.alias("problem"))


_COVER = "CASE WHEN chars < 200 THEN 'INSUFFICIENT_FOR_EVALUATION' WHEN chars >= 8000 THEN 'COMPLETE_ENOUGH' WHEN article < 2 AND chars >= 2000 THEN 'PARTIAL_BUT_USABLE' WHEN article < 2 THEN 'INSUFFICIENT_FOR_EVALUATION' ELSE 'PARTIAL_NEEDS_RECOVERY' END"


@query(_Q + f""", h AS (SELECT *, CASE WHEN title = '' THEN 'insufficient_identity' ELSE 'high_confidence' END AS known, {_COVER} AS cover, article >= 2 AS journal_like FROM g),
w AS (SELECT *, known = 'insufficient_identity' AS poor, flagged AND {_USABLE.format('title', " OR length(trim(title)) >= 20")} AS saved, journal_like AND cover NOT IN ('COMPLETE_ENOUGH', 'PARTIAL_BUT_USABLE') AS uncovered, flagged AND chars >= 2000 AND known <> 'insufficient_identity' AS partly FROM h)
SELECT doc, NOT (problem IS NOT NULL OR (status <> 'TEXT_OK' AND chars < 200) OR (poor AND NOT saved) OR (uncovered AND NOT partly)) AS can_evaluate, concat_ws(',', CASE WHEN problem IS NOT NULL THEN 'invalid_title' END, CASE WHEN status <> 'TEXT_OK' AND chars < 200 THEN 'insufficient_text' END,
  CASE WHEN poor AND saved THEN 'first_pass_identity_recovered' WHEN poor THEN 'insufficient_identity' END, CASE WHEN uncovered AND partly THEN 'first_pass_partial_coverage:' || cover WHEN uncovered THEN 'insufficient_coverage:' || cover END) AS reasons FROM w""")
def c_20(spark, sf_dir):
    """Whether a row may be rated, with the reasons; flagged rows stand for a first pass (C-20)."""
    r = rows(spark, sf_dir).withColumn("cover", F.expr(_COVER))
    known = F.when(c("title") == "", "insufficient_identity").otherwise("high_confidence")
    made = titles.input_health(
        c("title"), F.split("authors", ";"), c("year"), c("doi"), known, c("status"), c("chars"), c("cover"), c("article") >= 2, c("cover").isin("COMPLETE_ENOUGH", "PARTIAL_BUT_USABLE"), c("flagged")
    )
    return r.select("doc", made.alias("h")).select("doc", "h.can_evaluate", F.array_join("h.reasons", ",").alias("reasons"))


# Texts as books: some get a table of contents, dotted entries and chapters in place of their sentences and lines.
_BOOK = """CASE n_chars % 4 WHEN 0 THEN 'Foreword' || chr(10) || chr(10) || '  Contents' || chr(10) || replace(coalesce(text, ''), '. ', ' .... ' || doc_id % 90 || chr(10)) WHEN 1 THEN 'Part IV:  ' || replace(coalesce(text, ''), chr(10), chr(10) || 'Chapter 3. ')
  WHEN 2 THEN 'contents of this book' || chr(10) || '1. First steps' || chr(10) || 'Acknowledgements' || chr(10) || 'Index' || chr(10) || replace(coalesce(text, ''), '. ', chr(10) || '12 ') ELSE text END"""
_LINES = r"list_filter(list_transform(regexp_split_to_array({0}, '\r\n|\n|\r'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"


@query(f"WITH l AS (SELECT doc_id, {_LINES.format(_BOOK)} AS l FROM documents), " + r"""s AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: lower(x) IN ('contents', 'table of contents') OR starts_with(lower(x), 'contents ')), true) AS pos FROM l),
e AS (SELECT *, l[pos + 1:pos + 89] AS below FROM s), f AS (SELECT *, list_position(list_transform(below, lambda x: lower(x) IN ('references', 'index')), true) AS stop FROM e),
g AS (SELECT *, list_filter(CASE WHEN stop IS NULL OR stop = 0 THEN below ELSE below[1:stop - 1] END, lambda x: length(x) BETWEEN 4 AND 180 AND (regexp_matches(x, '\.{2,}\s*[0-9]+$') OR regexp_matches(lower(x), '^(chapter\s+)?[0-9]+[.:]?\s+\S') OR regexp_matches(lower(x), 'introduction|references|acknowledg|contributors'))) AS found,
  list_filter(list_transform(l, lambda x, i: {'line': i - 1, 'heading': x}), lambda c: length(c.heading) <= 160 AND (regexp_matches(lower(c.heading), '^(chapter|part)\s+[0-9ivxlcdm]+[:.\s-]+\S') OR regexp_matches(c.heading, '^[0-9]{1,2}\s+[A-Z][A-Za-z].{8,}$'))) AS heads FROM f)
SELECT doc_id, coalesce(pos, 0) > 0 AS toc_found, CASE WHEN pos > 0 THEN pos - 1 END AS toc_line, CASE WHEN coalesce(pos, 0) > 0 THEN least(len(list_distinct(list_transform(found, lambda x: lower(x)))), 25) ELSE 0 END AS n_entries, CASE WHEN pos > 0 THEN lower(found[1]) END AS first_entry,
  least(len(heads), 30) AS n_chapters, heads[1].line AS first_line, heads[least(len(heads), 30)].line AS last_line, heads[1].heading AS first_heading FROM g""")
def c_38(spark, sf_dir):
    """Tables of contents and headings of chapters in whole texts (C-38): entries within ninety lines, thirty headings at most."""
    docs = View("documents", {"doc_id": "doc_id", "book": _BOOK}).df(spark, sf_dir).select("doc_id", contents.lines(c("book")).alias("l"))
    r = docs.select("doc_id", contents.table_of_contents(c("l")).alias("t"), contents.chapters(c("l")).alias("h"))
    return r.select(
        "doc_id", c("t.found").alias("toc_found"), c("t.line").cast("long").alias("toc_line"), F.size("t.entries").cast("long").alias("n_entries"), F.get("t.entries", F.lit(0)).alias("first_entry"), F.size("h").cast("long").alias("n_chapters"),
        F.get("h", F.lit(0))["line"].cast("long").alias("first_line"), F.get("h", F.size("h") - 1)["line"].cast("long").alias("last_line"), F.get("h", F.lit(0))["heading"].alias("first_heading"),
    )


_PAGE = "CASE n_chars % 5 WHEN 0 THEN 'Edited by many' || chr(10) WHEN 1 THEN 'An Oxford Handbook, 1999' || chr(10) WHEN 2 THEN 'ISBN 0-19-852663-6' || chr(10) ELSE '' END || coalesce(text, '')"
_WANTED = f"CASE doc_id % 4 WHEN 0 THEN {word(1)} || ' ' || {word(2)} WHEN 1 THEN {word(1)} || ' ' || {word(3)} || ' of ' || {word(5)} WHEN 2 THEN 'Cognition ' || {word(4)} || ' and theory' ELSE '' END"


@query(f"WITH d AS (SELECT doc_id, lang, {_WANTED} AS title, {_LINES.format(_PAGE)}[1:250] AS l FROM documents), " + f"""e AS (SELECT doc_id, lang, {sql_norm('title')} AS k, list_transform(l, lambda x: {sql_norm('x')}) AS n, lower(array_to_string(l[1:200], chr(10))) AS low FROM d),
f AS (SELECT *, replace(array_to_string(n, ''), ' ', '') AS whole, list_filter(string_split(k, ' '), lambda w: length(w) >= 4 AND w NOT IN ('the', 'of', 'and', 'a', 'an', 'to', 'in', 'for')) AS w FROM e),""" + r"""
g AS (SELECT *, CASE WHEN k = '' THEN NULL WHEN len(list_filter(n, lambda x: x <> '' AND (contains(x, k) OR contains(k, x)))) > 0 THEN 'line' WHEN contains(whole, replace(k, ' ', '')) THEN 'compact' WHEN len(list_filter(w, lambda x: contains(whole, x))) >= greatest(2, len(w) * 6 // 10) THEN 'fragments' END AS how,
  contains(low, 'editor') OR regexp_matches(low, '\b(edited by|editors?|contributors?)\b') AS ed, contains(whole, 'handbook') OR contains(whole, 'companion') OR regexp_matches(low, '\b(handbook|companion|oxford handbooks|cambridge handbooks)\b') AS hb, contains(low, 'isbn') AS isbn, lang <> 'es' AND regexp_matches(low, '\b(?:19|20)[0-9]{2}\b') AS yr, lang = 'fr' AS doi FROM f)
SELECT doc_id, 12 * (how IS NOT NULL)::INT + 8 * ed::INT + 6 * hb::INT + 4 * isbn::INT + 4 * yr::INT + 2 * doi::INT AS score, how, concat_ws(',', CASE WHEN how IS NOT NULL THEN 'title' END, CASE WHEN ed THEN 'editor' END, CASE WHEN hb THEN 'handbook' END, CASE WHEN isbn THEN 'isbn' END, CASE WHEN yr THEN 'year' END, CASE WHEN doi THEN 'doi' END) AS reasons,
  CASE WHEN k = '' THEN 'missing_title' WHEN how IS NULL THEN 'title_not_confirmed' END AS blocker FROM g""")
def c_39(spark, sf_dir):
    """How well a title page confirms a title: six tests with their points (C-39); the page ends at 250 lines by the rule."""
    d = View("documents", {"doc_id": "doc_id", "lang": "lang", "title": _WANTED, "page": _PAGE}).df(spark, sf_dir)
    year, doi = F.when(c("lang") != "es", "1999"), F.when(c("lang") == "fr", "10.1/x")
    made = contents.title_page(contents.lines(c("page")), c("title"), year, doi, F.lit(False))
    return d.select("doc_id", made.alias("s")).select("doc_id", "s.score", "s.how", F.array_join("s.reasons", ",").alias("reasons"), "s.blocker")
