"""Queries that read articles out of documents and pages: numbers, titles, sections, signals, exports. Each has its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import gates, identity, text
from vellum.operators import linkage, store
from vellum.plans.common import NOW, sql_norm, sql_strip
from vellum.sources.session import ensure_checkpoint_dir
from vellum.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


_TITLE = "regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)"

# -- text


@query(f"""SELECT page_id, array_to_string(list_filter(regexp_extract_all(lower({_TITLE}), '[a-z0-9]+'), lambda w: length(w) > 2
  AND w NOT IN ('a', 'an', 'and', 'as', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'with')), ' ') AS tokens FROM pages""")
def s_11(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.title_tokens(F.expr(_TITLE)), " ").alias("tokens"))


_PRINTED = "text || ' ISBN 978-0-' || (100 + doc_id % 800) || '-' || (10000 + doc_id % 90000) || '-' || (doc_id % 10) || '; 0-19-852663-' || (doc_id % 7) || ' end'"


@query(rf"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all({_PRINTED}, '\b(?:97[89][-\s]?)?[0-9][-\s]?[0-9]{{2,5}}[-\s]?[0-9]{{2,7}}[-\s]?[0-9]{{1,7}}[-\s]?[0-9X]\b')) AS x FROM documents),
g AS (SELECT DISTINCT doc_id, {sql_strip('x')} AS x FROM f WHERE length(regexp_replace(x, '[^0-9X]', '', 'g')) IN (10, 13) AND regexp_matches(regexp_replace(x, '[^0-9X]', '', 'g'), '^(97|0|1)'))
SELECT d.doc_id AS doc_id, least(count(x), 12) AS n FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY 1""")
def s_36(spark, sf_dir):
    """Book numbers of whole texts, to which two are added."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.isbns(F.expr(_PRINTED))).cast("long").alias("n"))


_MARKED = "CASE doc_id % 3 WHEN 0 THEN 'By the authors. ABSTRACT ' || text || ' Keywords one' WHEN 1 THEN 'Abstract ' || text || chr(10) || ' 1. First' ELSE text END"


@query(rf"""WITH x AS (SELECT doc_id, regexp_extract({_MARKED}, '(?is)\babstract\b\s*(.+?)(?:\bkeywords\b|\bintroduction\b|\n\s*1[.\s]|$)', 1) AS a FROM documents)
SELECT doc_id, sha256(substring({sql_strip("regexp_replace(a, '\\s+', ' ', 'g')").replace(chr(92) * 2, chr(92))}, 1, 1600)) AS abstract FROM x""")
def s_37(spark, sf_dir):
    """Abstracts between their marks, which two thirds of the texts are given; as digests."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.abstract(F.expr(_MARKED)), 256).alias("abstract"))


_NAME = "source || CASE WHEN doc_id % 4 = 0 THEN '_12001999' ELSE '' END || '_' || (1990 + doc_id % 30) || '_' || regexp_replace(lower(substring(text, 1, 40)), '[^a-z]+', '_'{}) || CASE doc_id % 3 WHEN 0 THEN '_supplement_2' WHEN 1 THEN '_XAI_part_1' ELSE '' END || '.pdf'"


@query(f"""WITH n AS (SELECT doc_id, replace({_NAME.format(", 'g'")}, '.pdf', '') AS stem FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_extract(stem, '(?:^|[^0-9])(?:19[0-9]{{2}}|20[0-2][0-9])(?:[_\\- ]+(.*))?$', 1), '_supplement_[0-9]+$', ''), '_part_[0-9]+$', '') AS x FROM n),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(x, '[_\\s]+'), lambda v: v <> '') AS w FROM a)
SELECT doc_id, CASE WHEN len(w) >= 3 THEN array_to_string(list_transform(w, lambda v: CASE WHEN upper(v) = v AND lower(v) <> v THEN v ELSE upper(v[1]) || lower(v[2:]) END), ' ') END AS title FROM w""")
def s_21(spark, sf_dir):
    """Titles from the file names that documents would have."""
    return table(spark, sf_dir, "documents").select("doc_id", text.title_of_name(F.expr(_NAME.format(""))).alias("title"))


_H1 = "regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)"


@query(f"""SELECT page_id, concat_ws(chr(10) || chr(10), CASE WHEN trim({_TITLE}) <> '' THEN '=== ABSTRACT ===' || chr(10) || trim({_TITLE}) END, CASE WHEN page_id % 3 > 0 THEN '=== MAIN RESULTS ===' || chr(10) || {sql_strip(_H1)} END,
  '=== NOTES ===' || chr(10) || 'page ' || page_id, '=== REFERENCE LIST ===' || chr(10) || trim(url)) AS pack FROM pages""")
def l_07(spark, sf_dir):
    """The parts of a page as sections in the order of a pack, blank ones left out."""
    h1 = F.when(F.col("page_id") % 3 > 0, F.expr(_H1)).otherwise(" \n")
    pairs = [F.lit("Reference list"), F.col("url"), F.lit("notes"), F.concat(F.lit(" page "), "page_id"), F.lit("Main Results"), h1, F.lit("Abstract"), F.expr(_TITLE)]
    return table(spark, sf_dir, "pages").select("page_id", text.joined_sections(F.create_map(*pairs)).alias("pack"))


_SECTION = "CASE turn % 6 WHEN 0 THEN 'Background' WHEN 1 THEN 'Funding statement' WHEN 2 THEN 'Appendix B' WHEN 3 THEN 'Bibliography' WHEN 4 THEN 'Figure - captions' ELSE role END"


@query(f"""WITH s AS (SELECT conv_id, turn, regexp_replace(lower(trim({_SECTION})), '[\\s-]+', '_', 'g') AS k, text FROM conversations)
SELECT k, CASE k WHEN 'background' THEN 15 WHEN 'appendix_b' THEN 90 WHEN 'bibliography' THEN 115 WHEN 'figure_captions' THEN 55 ELSE 50 END AS rank,
  CASE k WHEN 'background' THEN 'critical' WHEN 'figure_captions' THEN 'critical' WHEN 'funding_statement' THEN 'acknowledgements' WHEN 'appendix_b' THEN 'supplement' WHEN 'bibliography' THEN 'references' ELSE 'standard' END AS bucket,
  count(*) AS n, sum(length(text))::BIGINT AS chars FROM s GROUP BY 1, 2, 3""")
def l_07_buckets(spark, sf_dir):
    """Sections by rank and kind, with their characters."""
    name = F.expr(_SECTION)
    s = table(spark, sf_dir, "conversations").select(text.section_key(name).alias("k"), text.section_rank(name).alias("rank"), text.section_bucket(name).alias("bucket"), F.length("text").alias("size"))
    return s.groupBy("k", "rank", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))


# -- signals and choices


_PII = "'S' || lpad(page_id::VARCHAR, 16, '0')"


@query(rf"""WITH p AS (SELECT page_id, lower(html) AS t, lower(url) AS f, {_TITLE} AS title, CASE WHEN page_id % 5 = 0 THEN {_PII} ELSE '' END AS pii, length(regexp_replace(html, '\s+', ' ', 'g')) AS n FROM pages),
h AS (SELECT *, contains(t, 'abstract')::INT + contains(t, 'introduction')::INT + contains(t, 'method')::INT + contains(t, 'result')::INT + contains(t, 'discussion')::INT + contains(t, 'reference')::INT AS hits FROM p)
SELECT page_id, CASE WHEN hits >= 2 THEN 2 ELSE 0 END + CASE WHEN pii <> '' OR regexp_matches(t, '10\.[0-9]{{4,9}}/') THEN 1 ELSE 0 END + CASE WHEN n // 1500 >= 3 THEN 1 ELSE 0 END AS journal_article_signals,
  CASE WHEN hits >= 4 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, '\b(participants|subjects|n\s*=\s*[0-9]+|experiment|study)\b') THEN 1 ELSE 0 END AS empirical_signals,
  CASE WHEN regexp_matches(f, '\b(handbook|manual|dictionary|standard|protocol|guideline|tutorial)\b') THEN 2 ELSE 0 END
    + CASE WHEN regexp_matches(f, '\b(book|chapter|atlas)\b') AND NOT contains(f, 'review paper') THEN 1 ELSE 0 END AS reference_material_signals, 0 AS child_support_signals,
  CASE WHEN n < 200 THEN 1 ELSE 0 END + CASE WHEN length(title) < 20 THEN 2 ELSE 0 END AS insufficient_evidence_signals FROM h""")
def agg_27(spark, sf_dir):
    """The five scores of a page: article, empirical, reference material, child (which no rule raises), too little evidence."""
    pii = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("S"), F.lpad(F.col("page_id").cast("string"), 16, "0"))).otherwise("")
    low, name, title = F.lower("html"), F.lower("url"), F.expr(_TITLE)
    size = F.length(F.regexp_replace("html", r"\s+", " "))
    found = gates.article_signals(low, name, (pii != "") | low.rlike(r"10\.[0-9]{4,9}/"), F.floor(size / 1500), size, F.length(title) < 20)
    return table(spark, sf_dir, "pages").select("page_id", found.alias("s")).select("page_id", "s.*")


@query(f"""WITH t AS (SELECT page_id, {sql_norm(_TITLE)} AS key, contains(url, '?') AS rejected, length(html) AS confidence FROM pages)
SELECT key, page_id, rejected, confidence FROM t WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY rejected, confidence DESC, page_id) = 1""")
def win_05(spark, sf_dir):
    """The best page of each title: accepted before rejected, then the surest; an aggregate, so that a common title is no hot window."""
    t = table(spark, sf_dir, "pages").select(
        text.norm_sp(F.expr(_TITLE)).alias("key"), F.contains("url", F.lit("?")).alias("rejected"), F.length("html").alias("confidence"), "page_id"
    )
    best = F.min(F.struct("rejected", (-F.col("confidence")).alias("less"), "page_id")).alias("b")
    return t.filter("key <> ''").groupBy("key").agg(best).select("key", "b.page_id", "b.rejected", (-F.col("b.less")).alias("confidence"))


# -- exports


@query("""SELECT user_id::VARCHAR AS user_id, CASE WHEN event_id % 3 <> 0 THEN '{"kind":"' || event_type || '","user":' || user_id || '}' END AS what,
'["' || event_type || '","' || user_id || '"]' AS tags FROM events""")
def snk_05(spark, sf_dir):
    """Each column as text: nested ones as JSON, null as null."""
    what = F.when(F.col("event_id") % 3 != 0, F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    return store.serialised(table(spark, sf_dir, "events").select("user_id", what.alias("what"), F.array("event_type", F.col("user_id").cast("string")).alias("tags")))


@query(f"""SELECT '{{"item_id":' || item_id || ',"chars":' || length(text) || '}}' AS value FROM benchmark
UNION ALL SELECT '{{"exported_from":"benchmark","export_date":"{NOW[:10]}","total":' || count(*) || '}}' FROM benchmark""")
def snk_06(spark, sf_dir):
    """A table as lines of JSON below one on the export, written and read back."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("chars"))
    return store.dump(rows, "benchmark", NOW[:10], store.folder(spark, "dump"))


@query("SELECT doc_id, lang, source, n_chars, CASE WHEN doc_id % 2 = 0 THEN 'a \"quoted\", text' END AS note FROM documents")
def snk_07(spark, sf_dir):
    """The catalogue of documents as CSV with a header, written and read back."""
    note = F.when(F.col("doc_id") % 2 == 0, 'a "quoted", text').alias("note")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", note)
    path = store.folder(spark, "csv")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


# -- ladders

_PAGE = """html || CASE page_id % 6 WHEN 0 THEN ' Access denied: 403 forbidden, please enable cookies ' WHEN 1 THEN ' Supporting information and appendix '
WHEN 2 THEN ' see doi.org/10.1234/ab.' || page_id || ' captcha' ELSE '' END"""
_BARE = f"CASE WHEN page_id % 4 = 0 THEN regexp_replace({_PAGE}, '<title[^>]*>[^<]*</title>', '') ELSE {_PAGE} END"


@query(rf"""WITH p AS (SELECT page_id, {_BARE} AS h FROM pages), l AS (SELECT page_id, h, lower(h) AS low, trim(regexp_extract(h, '(?is)<title[^>]*>([^<]{{4,300}})</title>', 1)) AS title FROM p),
s AS (SELECT page_id, length(h) AS size,
  regexp_matches(low, 'there was a problem providing the content')::INT + contains(low, 'access denied')::INT + contains(low, '403 forbidden')::INT + contains(low, '404 not found')::INT
  + contains(low, 'page not found')::INT + regexp_matches(low, 'cookie.?consent')::INT + contains(low, 'enable cookies')::INT + contains(low, 'refused to connect')::INT + contains(low, 'service unavailable')::INT
  + contains(low, 'temporarily unavailable')::INT + regexp_matches(low, 'robot.?check')::INT + contains(low, 'captcha')::INT + contains(low, 'sign in to continue')::INT + contains(low, 'purchase this article')::INT
  + contains(low, 'institutional access')::INT AS junk,
  contains(low, 'doi.org/')::INT + contains(low, 'supplement')::INT + contains(low, 'supplementary')::INT + regexp_matches(low, 'mmc[0-9]')::INT + contains(low, 'supporting information')::INT + contains(low, 'appendix')::INT
  + contains(low, 'erratum')::INT + contains(low, 'corrigendum')::INT + contains(low, 'abstract')::INT + contains(low, 'journal')::INT + contains(low, 'sciencedirect.com/science/article')::INT
  + (length(title) >= 8 AND NOT regexp_matches(lower(title), 'error|denied|cookie|sign in'))::INT + CASE WHEN regexp_matches(low, '10\.[0-9]{{4,9}}/[^\s"''<>]+') THEN 2 ELSE 0 END AS useful FROM l)
SELECT page_id, junk, useful, CASE WHEN junk >= 2 AND useful = 0 THEN 'HTML_OR_TEXT_JUNK' WHEN page_id % 5 = 0 THEN 'HTML_OR_TEXT_CHILD_DOCUMENT' WHEN useful >= 1 THEN 'HTML_OR_TEXT_REFERENCE'
  WHEN size < 200 THEN 'HTML_OR_TEXT_JUNK' ELSE 'MODEL_RECOVERY_REQUIRED' END AS class FROM s""")
def c_07(spark, sf_dir):
    """Pages by all signs of junk and of use."""
    html = F.expr(_BARE)
    p = table(spark, sf_dir, "pages").select("page_id", html.alias("h")).select("page_id", F.length("h").alias("size"), gates.html_scores(F.col("h")).alias("s"))
    return p.select("page_id", "s.junk", "s.useful", gates.html_class(F.col("s"), F.col("size"), F.col("page_id") % 5 == 0).alias("class"))


_MAIL = """CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN substring(text, 1, 50) || chr(10) || 'Content-Disposition: ATTACHMENT; filename=.pdf' WHEN 2 THEN substring(text, 1, 80) || ' 10.1000/x' || conv_id ELSE '  ' || substring(text, 1, 30) END"""


@query(rf"""WITH m AS (SELECT conv_id, turn, {_MAIL} AS m FROM conversations)
SELECT conv_id, turn, contains(lower(m), 'application/pdf') OR contains(lower(m), 'filename="*.pdf"') OR contains(lower(m), 'filename=.pdf') OR contains(lower(m), 'content-disposition: attachment')
  OR contains(lower(m), 'content-type: application/') OR regexp_matches(m, '10\.[0-9]{{4,9}}/[^\s"''<>]+') OR length({sql_strip('m')}) > 400 AS recoverable FROM m""")
def c_08(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", gates.mime_recoverable(F.expr(_MAIL)).alias("recoverable"))


_ITEM = """CASE doc_id % 5 WHEN 0 THEN 'Conference  Abstracts. ' || text WHEN 1 THEN text || ' DOI: 10.1234/a1 and doi:10.1234/b' || doc_id WHEN 2 THEN 'A conference abstract. ' || text ELSE text END"""


_ITEM_TITLE = "CASE WHEN doc_id % 7 = 3 THEN 'Abstracts / ' || source ELSE source END"


@query(rf"""WITH d AS (SELECT doc_id, {_ITEM} AS t, {_ITEM_TITLE} AS title, (n_chars // 1500 + 1)::INT AS pages, CASE WHEN n_chars < 2000 THEN 'INSUFFICIENT_FOR_EVALUATION' ELSE 'COMPLETE_ENOUGH' END AS status FROM documents),
s AS (SELECT *, lower(regexp_replace('file ' || title || ' ' || substring(t, 1, 12000), '\s+', ' ', 'g')) AS sample, len(regexp_extract_all(lower(t), '\bdoi\s*:\s*10\.[0-9]{{4,9}}/\S+')) AS dois FROM d),
r AS (SELECT *, contains(sample, 'abstracts /') OR contains(sample, 'conference abstracts') AS marker FROM s)
SELECT doc_id, (marker OR dois >= 2 OR (contains(sample, 'conference abstract') AND (pages <= 2 OR status <> 'COMPLETE_ENOUGH'))) AND status <> 'COMPLETE_ENOUGH' AS limited,
  concat_ws(',', CASE WHEN marker THEN 'page_marker' END, CASE WHEN dois >= 2 THEN 'several_dois' END, CASE WHEN pages <= 2 THEN 'few_pages' END, CASE WHEN status <> 'COMPLETE_ENOUGH' THEN 'coverage' END) AS reasons FROM r""")
def c_05(spark, sf_dir):
    """Abstracts and proceedings; the sample for the marks has a bound of its own, DOIs are counted in whole texts."""
    status = F.when(F.col("n_chars") < 2000, "INSUFFICIENT_FOR_EVALUATION").otherwise("COMPLETE_ENOUGH")
    found = gates.limited_item(F.lit("file"), F.expr(_ITEM_TITLE), F.expr(_ITEM), F.floor(F.col("n_chars") / 1500) + 1, status, status == "COMPLETE_ENOUGH")
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("f")).select("doc_id", "f.limited", F.array_join("f.reasons", ",").alias("reasons"))


_PAPER = "text || CASE doc_id % 4 WHEN 0 THEN ' Abstract. Materials and Methods. Results' WHEN 1 THEN ' INTRODUCTION and discussion' WHEN 2 THEN ' methodical resultant references' ELSE '' END"


@query(rf"""WITH t AS (SELECT doc_id, source, lang, lower({_PAPER}) AS t FROM documents),
s AS (SELECT doc_id, source, lang, regexp_matches(t, '\babstract\b') AS a, regexp_matches(t, '\bintroduction\b') AS i, regexp_matches(t, '\b(?:materials?\s+and\s+)?methods?\b') AS m,
  regexp_matches(t, '\bresults?\b') AS r, regexp_matches(t, '\bdiscussion\b') AS d, regexp_matches(t, '\breferences\b') AS f FROM t)
SELECT doc_id, concat_ws(',', CASE WHEN a THEN 'abstract' END, CASE WHEN i THEN 'introduction' END, CASE WHEN m THEN 'methods' END, CASE WHEN r THEN 'results' END, CASE WHEN d THEN 'discussion' END, CASE WHEN f THEN 'references' END) AS sections FROM s""")
def c_14(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(gates.section_signals(F.expr(_PAPER)), ",").alias("sections"))


@query("""WITH e AS (SELECT event_id, (event_id % 3)::INT AS ja, (event_id // 3 % 3)::INT AS ref, event_type AS kind, CASE WHEN user_id % 3 = 0 THEN 'A Journal of ' || user_id ELSE 'journals_' || user_id END AS name,
  CASE WHEN event_id % 2 = 0 THEN event_type END AS title FROM events)
SELECT event_id, CASE WHEN ja >= 2 AND ref <= 1 THEN true WHEN kind IN ('journal_article', 'empirical', 'review', 'meta_analysis') AND ja >= 1 THEN true
  WHEN starts_with(name, 'A Journal') THEN ja >= 1 WHEN title IS NOT NULL AND ja >= 1 AND ref = 0 THEN true ELSE false END AS article FROM e""")
def c_15(spark, sf_dir):
    """Journal articles by their signals, type, file name and title."""
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("A Journal of "), "user_id")).otherwise(F.concat(F.lit("journals_"), "user_id"))
    title = F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
    return e.select("event_id", gates.likely_article(F.col("event_id") % 3, F.floor(F.col("event_id") / 3) % 3, F.col("event_type"), name, title).alias("article"))


@query("""WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Strong' WHEN 1 THEN 'flawed' ELSE 'adequate' END AS rating, CASE conv_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'LOW' END AS conf,
  text || CASE conv_id % 4 WHEN 0 THEN ' A Systematic Review' WHEN 1 THEN ' landmark rct' ELSE '' END AS j FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN 'validation_failed' ELSE concat_ws(',', CASE WHEN coalesce(lower(conf), 'medium') <> 'high' THEN 'confidence=' || coalesce(lower(conf), 'medium') END,
  CASE WHEN lower(rating) <> 'flawed' THEN 'borderline_rating=' || lower(rating) END, CASE WHEN length(j) < 200 THEN 'short_justification' END, CASE WHEN turn % 2 = 1 THEN 'critical_sections_omitted' END,
  'high_value_keyword:' || CASE WHEN contains(lower(j), 'systematic review') THEN 'systematic review' WHEN contains(lower(j), 'meta-analysis') THEN 'meta-analysis' WHEN contains(lower(j), 'meta analysis') THEN 'meta analysis'
    WHEN contains(lower(j), 'randomized') THEN 'randomized' WHEN contains(lower(j), 'rct') THEN 'rct' WHEN contains(lower(j), 'preregister') THEN 'preregister' WHEN contains(lower(j), 'landmark') THEN 'landmark' END) END AS reasons FROM c""")
def c_35(spark, sf_dir):
    """Why a result goes to the next model."""
    rating = F.when(F.col("turn") % 3 == 0, "Strong").when(F.col("turn") % 3 == 1, "flawed").otherwise("adequate")
    confidence = F.when(F.col("conv_id") % 3 == 0, "High").when(F.col("conv_id") % 3 == 1, "LOW")
    said = F.concat("text", F.when(F.col("conv_id") % 4 == 0, " A Systematic Review").when(F.col("conv_id") % 4 == 1, " landmark rct").otherwise(""))
    omitted = F.when(F.col("turn") % 2 == 1, F.array(F.lit("notes"), F.lit("Results 2"))).otherwise(F.array(F.lit("notes")))
    reasons = gates.escalation(rating, confidence, said, omitted, F.col("conv_id") % 11 == 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(reasons, ",").alias("reasons"))


# -- duplicates


def c_24(spark, sf_dir):
    """Documents that are surely the same as the next one in the order of their titles (no SQL: the ratio of texts)."""
    ensure_checkpoint_dir(spark)
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    d = table(spark, sf_dir, "documents").select(
        text.plain(line).alias("key"),
        F.concat(F.lit("doc_"), "doc_id").alias("id"),
        F.coalesce(text.doi(F.col("text")), F.lit("")).alias("doi"),
        line.alias("title"),
        F.substring(F.substr("text", F.length(line) + 2), 1, 1000).alias("abstract"),
        F.coalesce("source", F.lit("")).alias("file"),
    )
    fields = ["key", "id", "doi", "title", "abstract", "file"]
    pairs = linkage.following(d.fillna("", fields), fields).filter("next IS NOT NULL")
    a, b = F.struct(*fields), F.col("next")
    known = lambda f, r: F.when((F.col(f) != "") & (b[f] != ""), r).otherwise(0.0)
    ratios = pairs.withColumn("title_ratio", linkage.seq_ratio_from(F.col("key"), b["key"], identity.title_ratio_from(a, b)))
    title_ratio = known("key", F.col("title_ratio"))
    ratios = ratios.withColumn("abstract_ratio", linkage.seq_ratio_from(F.col("abstract"), b["abstract"], identity.abstract_ratio_from(a, b, title_ratio)))
    prefix = text.common_prefix(F.col("id"), b["id"])
    same = identity.likely_duplicates(a, b, title_ratio, known("abstract", F.col("abstract_ratio")), prefix)
    return ratios.select("id", b["id"].alias("next_id"), same.alias("duplicate"))


QUERIES["c_24"] = c_24


# -- tables, logs and files


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def src_03(spark, sf_dir):
    """All but the heavy column; the scan does not read it."""
    return table(spark, sf_dir, "documents").drop("text")


@query("SELECT doc_id, lang, sha256(coalesce(text, '')) AS text, CASE WHEN doc_id % 3 = 0 THEN 'native' END AS extraction FROM documents WHERE text <> '' OR doc_id % 3 = 0")
def snk_09(spark, sf_dir):
    """Whole texts as JSON lines, read back; their digests."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.when(F.col("doc_id") % 3 == 0, "native").alias("extraction"))
    return store.export_texts(d, "text", "extraction", store.folder(spark, "texts")).withColumn("text", F.sha2(F.coalesce("text", F.lit("")), 256))


@query("SELECT event_id, user_id, event_type FROM events UNION ALL SELECT event_id, user_id, 'again' FROM events WHERE event_type = 'error'")
def snk_12(spark, sf_dir):
    """A log of JSON lines, appended to twice and read back; lines that are blank or no object do not count (SRC-10)."""
    path, e = store.folder(spark, "log"), table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    store.append_events(e, path)
    store.append_events(e.filter("event_type = 'error'").withColumn("event_type", F.lit("again")), path)
    noise = spark.createDataFrame([("",), ("  ",), ("[1, 2]",), ('{"event_id": 1',)], "value string")
    noise.write.mode("append").text(path)
    return store.log(spark, path, e.schema.simpleString())


_TYPE = "CASE event_id % 6 WHEN 0 THEN ' Book Chapter ' WHEN 1 THEN 'conference-proceedings' WHEN 2 THEN 'Thesis' WHEN 3 THEN 'empirical' WHEN 4 THEN 'HANDBOOK' END"


@query(f"""SELECT event_id, coalesce(replace(replace(lower(trim({_TYPE})), '-', '_'), ' ', '_') IN ('book_chapter', 'conference_proceedings', 'thesis', 'handbook'), false) AS non_ratable FROM events""")
def flt_25(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", gates.non_ratable_type(F.expr(_TYPE)).alias("non_ratable"))


_LINE = "CASE page_id % 3 WHEN 0 THEN ' Ann  Lee-Smith, ' WHEN 1 THEN substring({0}, 1, 30) ELSE 'Handbook ' || substring({0}, 1, 20) END"


@query(rf"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace({_LINE.format(_TITLE)}, '\s+', ' ', 'g'), '^[ ,.;:]+|[ ,.;:]+$', '', 'g') AS c FROM pages), w AS (SELECT *, string_split(c, ' ') AS w FROM c)
SELECT page_id, length(c) BETWEEN 5 AND 80 AND len(w) BETWEEN 2 AND 5 AND len(list_filter(w, lambda x: length(regexp_replace(x, '[^A-Za-z-]', '', 'g')) >= 2)) >= 2
  AND len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}'))) >= 2
  AND NOT regexp_matches(lower(c), 'also available|altering fate|consciousness|deception|development|emotion and|guilford|handbook|isbn|lying|mind in context|past does not predict|psychological construction') AS is_name FROM w""")
def flt_33(spark, sf_dir):
    """Lines that look like a person's name."""
    return table(spark, sf_dir, "pages").select("page_id", identity.person_name(F.expr(_LINE.format(_TITLE))).alias("is_name"))


@query("SELECT doc_id, n_chars % 7 >= 3 AND length(text) < 200 AS scan FROM documents")
def flt_37(spark, sf_dir):
    """Documents of several pages with hardly any text."""
    return table(spark, sf_dir, "documents").select("doc_id", gates.scan_like(F.col("n_chars") % 7, F.length("text")).alias("scan"))


@query(f"SELECT event_id FROM events WHERE TIMESTAMP '{NOW}' >= ts + INTERVAL 14 DAY")
def flt_38(spark, sf_dir):
    """Files rejected a fortnight ago."""
    return table(spark, sf_dir, "events").filter(gates.expired(F.col("ts"), F.lit(NOW).cast("timestamp"))).select("event_id")


_FOLDERS = ("source_pdfs", "staging_metadata", "pending_parent", "staging", "backups", "logs", "audit", "cache", "other")
_PATH = "'/store/' || CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(_FOLDERS)) + " END || '/' || source || doc_id || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.pending.json' WHEN 2 THEN '.md' ELSE '.staging.json' END"


@query(f"""WITH p AS (SELECT doc_id, {_PATH} AS path FROM documents), o AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1), s AS (SELECT o_custkey AS doc_id, count(*) AS n FROM orders GROUP BY 1)
SELECT p.doc_id AS doc_id, CASE WHEN o.n = 1 THEN 'db_owned_source_pdf' WHEN o.n > 1 THEN 'db_owned_source_pdf_ambiguous' WHEN s.n = 1 THEN 'source_pdf_supplement_child' WHEN s.n > 1 THEN 'source_pdf_supplement_child_ambiguous'
  WHEN p.doc_id % 9 = 0 THEN 'source_pdf_unowned_or_unmatched' WHEN p.doc_id % 9 = 1 OR p.doc_id % 4 = 3 THEN 'sidecar' WHEN p.doc_id % 9 = 2 THEN CASE WHEN p.doc_id % 4 = 1 THEN 'sidecar' ELSE 'pending_child_support_doc' END
  WHEN p.doc_id % 9 = 3 THEN 'staging_file' WHEN p.doc_id % 9 = 4 THEN 'backup' WHEN p.doc_id % 9 = 5 THEN 'log' WHEN p.doc_id % 9 = 6 THEN 'audit' WHEN p.doc_id % 9 = 7 THEN 'cache'
  WHEN p.doc_id % 4 IN (1, 2) THEN 'code_config' ELSE 'unknown_runtime_file' END AS owner FROM p LEFT JOIN o ON o.doc_id = p.doc_id LEFT JOIN s ON s.doc_id = p.doc_id""")
def c_32(spark, sf_dir):
    """Owners of paths, by the rows that name them (labels and orders stand for those) and by folder."""
    count = lambda t, key, name: table(spark, sf_dir, t).groupBy(F.col(key).alias("doc_id")).agg(F.count("*").alias(name))
    p = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("path"))
    p = p.join(count("labels", "doc_id", "owners"), "doc_id", "left").join(count("orders", "o_custkey", "others"), "doc_id", "left")
    return p.select("doc_id", identity.path_owner(F.col("path"), F.col("owners"), F.col("others")).alias("owner"))


@query("""WITH r AS (SELECT sha256(coalesce(length(page_id::VARCHAR) || ':' || page_id, '-') || coalesce(length(length(html)::VARCHAR) || ':' || length(html), '-') || coalesce(length(url) || ':' || url, '-')) AS h FROM pages)
SELECT count(*) AS n, coalesce(sum(('0x' || substring(h, 1, 15))::BIGINT), 0)::VARCHAR AS digest FROM r""")
def agg_29(spark, sf_dir):
    """A digest of a set of files by name, size and version, whatever their order."""
    files = table(spark, sf_dir, "pages").select(F.col("url").alias("rel"), F.length("html").alias("bytes"), F.col("page_id").alias("at"))
    return store.digest(files, "rel")
