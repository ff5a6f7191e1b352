"""Queries over a catalogue of papers made of the supplied documents and labels: its rules, projections, links and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import identity, text
from vellum.operators import dedup, store
from vellum.plans.common import Union, View, pick, sql_norm, word

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Papers are documents: words of the text name them, their length gives the year, the language and
# the source say what is missing or oddly named; labels give ratings, and each labelled document has a supplement.
_LETTERS = "translate(cast(doc_id AS STRING), '0123456789', 'abcdefghij')"
_YEAR = "cast(1900 + n_chars % 150 AS STRING)"
_ID = f"({word(1)} || '_' || {_YEAR} || '_' || {word(2)} || {_LETTERS})"
_OWN_ID = f"""(CASE source WHEN 'src1' THEN '1_s2_0_S' || lpad(cast(doc_id AS STRING), 16, '0') || '_main' WHEN 'src2' THEN 'orphan_' || doc_id
  WHEN 'src4' THEN 'Unknown_Unknown_' || doc_id WHEN 'src5' THEN 'BF' || lpad(cast(doc_id AS STRING), 8, '0') ELSE {_ID} END)"""
_DOI = "'10.1016/' || substring(SHA<substring(text, 1, 60)>SHA, 1, 10)"
MAIN = View(
    "labelled",
    {
        "id": _OWN_ID,
        "added": "'2026-0' || (1 + doc_id % 9) || '-' || lpad(cast(1 + n_chars % 28 AS STRING), 2, '0')",
        "kind": "CASE WHEN n_chars > 12000 THEN 'book' WHEN lang = 'es' THEN NULL ELSE 'journal_article' END",
        "title": "CASE WHEN source = 'src2' THEN '' ELSE substring(split_part(text, chr(10), 1), 1, 120) END",
        "authors": f"CASE source WHEN 'src8' THEN '' WHEN 'src9' THEN 'van den ' || {word(1)} || ', A.' ELSE {word(1)} || ', A.;' || {word(2)} || ', B.;' || {word(3)} END",
        "year": f"CASE source WHEN 'src6' THEN '' WHEN 'src7' THEN '19xx' ELSE {_YEAR} END",
        "doi": f"CASE lang WHEN 'es' THEN NULL WHEN 'de' THEN '' ELSE {_DOI} || CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE '' END END",
        "journal": f"CASE WHEN quality = 1 THEN 'Journal of ' || {word(2)} ELSE '' END",
        "venue": f"CASE WHEN lang = 'fr' THEN 'Revue ' || {word(3)} ELSE '' END",
        "abstract": "substring(text, 121, 300)",
        "tags": "CASE WHEN source = 'src3' THEN '' ELSE lang || ',' || source END",
        "rating": "CASE WHEN quality = 1 AND toxic = 0 THEN 'strong' WHEN quality = 1 THEN 'NO_RATING' WHEN quality = 0 THEN 'weak' WHEN lang = 'fr' THEN '' END",
        "survived": "CASE WHEN quality IS NOT NULL THEN toxic = 0 END",
        "original": f"""CASE source WHEN 'src10' THEN '-' || (10000 + doc_id) || '.pdf' WHEN 'src11' THEN SHA<text>SHA || '.pdf' WHEN 'src12' THEN 'download.pdf'
  ELSE lower({word(1)}) || '_' || (doc_id % 7) || '_' || (doc_id % 5) || '.pdf' END""",
        "renamed": f"""CASE source WHEN 'src1' THEN '1-s2.0-S' || doc_id || '_main.pdf' WHEN 'src4' THEN 'unknown_unknown_' || doc_id || '.pdf' WHEN 'src13' THEN lower({word(1)}) || ' (1).pdf'
  WHEN 'src14' THEN lower({_ID}) || '.pdf' WHEN 'src15' THEN '' ELSE {_OWN_ID} || '.pdf' END""",
        "path": "source || '/' || doc_id || '.pdf'",
        "chars": "CASE WHEN n_chars < 100 THEN 0 ELSE n_chars END",
        "status": "CASE WHEN n_chars >= 200 THEN 'TEXT_OK' ELSE 'OCR_REQUIRED' END",
    },
)
SUPPLEMENTS = View(
    "labelled",
    MAIN.columns
    | {
        "id": f"{_OWN_ID} || '_supplement'", "kind": "'supplement'", "title": f"'Supplementary tables of ' || {word(1)}", "doi": "cast(NULL AS STRING)", "journal": "''", "venue": "''",
        "abstract": "''", "tags": "'data'", "rating": "cast(NULL AS STRING)", "survived": "cast(NULL AS BOOLEAN)", "original": f"lower({word(1)}) || '_supp.docx'",
        "renamed": f"{_OWN_ID} || '_supplement.docx'", "path": "source || '/' || doc_id || '_supp.docx'", "chars": "n_chars % 2000",
    },
    "quality IS NOT NULL",
)
PAPERS = Union(MAIN, SUPPLEMENTS)
TOXIC = View("labelled", {"id": _OWN_ID}, "toxic = 1")
P = f"WITH {PAPERS.sql('p')} "


def papers(spark, sf_dir):
    return PAPERS.df(spark, sf_dir)


c = F.col


@query(P + "SELECT id, title FROM p WHERE id = (SELECT min(id) FROM p)")
def src_02(spark, sf_dir):
    """One row by its id, here the smallest."""
    p = papers(spark, sf_dir)
    return p.join(p.agg(F.min("id").alias("id")), "id", "left_semi").select("id", "title")


@query(P + "SELECT id, chars FROM p ORDER BY id LIMIT 3")
def src_05(spark, sf_dir):
    return papers(spark, sf_dir).select("id", "chars").orderBy("id").limit(3)


@query(P + f", w AS ({TOXIC.select()}) SELECT id, year FROM p WHERE id IN (SELECT id FROM w)")
def src_06(spark, sf_dir):
    """Rows by a list of ids, here those of the toxic documents."""
    return papers(spark, sf_dir).join(TOXIC.df(spark, sf_dir), "id", "left_semi").select("id", "year")


@query(P + "SELECT count(*) AS n FROM p")
def agg_01(spark, sf_dir):
    return papers(spark, sf_dir).agg(F.count("*").alias("n"))


@query(P + "SELECT id, title, substring(array_to_string(string_split(authors, ';')[1:6], '; '), 1, 700) AS authors, coalesce(nullif(trim(journal), ''), venue) AS journal, coalesce(rating, '') AS rating FROM p")
def prj_01(spark, sf_dir):
    """The search record (authors capped as in prj_05)."""
    authors = F.substring(F.array_join(F.slice(F.split("authors", ";"), 1, 6), "; "), 1, 700)
    return papers(spark, sf_dir).select("id", "title", authors.alias("authors"), F.coalesce(text.nz(F.trim("journal")), "venue").alias("journal"), F.coalesce("rating", F.lit("")).alias("rating"))


@query(P + "SELECT id, added, kind, title, year, doi, chars > 0 AS present, chars, status, status = 'OCR_REQUIRED' AS ocr_needed FROM p")
def prj_04(spark, sf_dir):
    return papers(spark, sf_dir).select("id", "added", "kind", "title", "year", "doi", (c("chars") > 0).alias("present"), "chars", "status", (c("status") == "OCR_REQUIRED").alias("ocr_needed"))


@query(P + "SELECT id, 'coverage=' || status || ' chars=' || chars || ' rating=' || coalesce(nullif(rating, ''), 'none') AS line FROM p")
def prj_10(spark, sf_dir):
    return papers(spark, sf_dir).select("id", F.format_string("coverage=%s chars=%d rating=%s", "status", "chars", F.coalesce(text.nz(c("rating")), F.lit("none"))).alias("line"))


@query(P + "SELECT id FROM p WHERE (rating IS NULL OR rating IN ('', 'NO_RATING')) AND (kind = 'journal_article' OR kind IS NULL)")
def flt_01(spark, sf_dir):
    return papers(spark, sf_dir).filter((c("rating").isNull() | c("rating").isin("", "NO_RATING")) & ((c("kind") == "journal_article") | c("kind").isNull())).select("id")


@query(P + "SELECT id FROM p WHERE coalesce(rating, '') IN ('', 'NO_RATING') AND coalesce(kind, '') NOT IN ('supplement', 'book', 'manual', 'thesis', 'book_chapter')")
def flt_02(spark, sf_dir):
    return papers(spark, sf_dir).filter(F.coalesce("rating", F.lit("")).isin("", "NO_RATING") & ~F.coalesce("kind", F.lit("")).isin("supplement", "book", "manual", "thesis", "book_chapter")).select("id")


@query(P + ", k AS (SELECT lower(trim(doi)) AS d, count(*) AS n FROM p WHERE trim(doi) <> '' GROUP BY 1), m AS (SELECT d FROM k ORDER BY n DESC, d LIMIT 1) SELECT id FROM p, m WHERE lower(trim(doi)) = d")
def flt_03(spark, sf_dir):
    """Rows of one DOI whatever its case and blanks, here of the one that most have."""
    rows = papers(spark, sf_dir).withColumn("d", F.lower(F.trim("doi")))
    most = rows.filter("d <> ''").groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1)
    return rows.join(most, "d", "left_semi").select("id")


@query(P + "SELECT id, trim(coalesce(title, '')) <> '' AS ok FROM p")
def flt_07(spark, sf_dir):
    return store.valid(papers(spark, sf_dir), "id", "title").select("id", (F.size("errors") == 0).alias("ok"))


@query(P + "SELECT id FROM p WHERE added >= '2026-02-25'")
def flt_08(spark, sf_dir):
    return papers(spark, sf_dir).filter("added >= '2026-02-25'").select("id")


@query(P + "SELECT id, chars > 50000 AS likely FROM p")
def flt_09(spark, sf_dir):
    return papers(spark, sf_dir).select("id", (c("chars") > 50000).alias("likely"))


@query(P + ", s AS (SELECT id, regexp_replace(original, '\\.[a-z]+$', '') AS stem FROM p) SELECT id, regexp_matches(stem, '^-?[0-9]{5,}$') OR (length(replace(stem, '-', '')) >= 16 AND regexp_matches(lower(replace(stem, '-', '')), '^[0-9a-f]+$')) OR lower(stem) IN ('download', 'download (1)', 'untitled') AS hash_like FROM s")
def flt_11(spark, sf_dir):
    return papers(spark, sf_dir).select("id", identity.hash_like(F.regexp_replace("original", r"\.[a-z]+$", "")).alias("hash_like"))


@query(P + f"SELECT id, contains(lower(id), 'unknown') AS unsafe, regexp_matches(id, '{identity.WEIRD}') AS weird, regexp_matches(id, '{identity.RELIABLE}') AS reliable, regexp_matches(id, '{identity.ORPHAN}') AS orphan FROM p")
def flt_12_to_15(spark, sf_dir):
    """Unsafe, weird, reliable and orphan ids (FLT-12 to FLT-15)."""
    i = c("id")
    return papers(spark, sf_dir).select("id", identity.unsafe_id(i).alias("unsafe"), i.rlike(identity.WEIRD).alias("weird"), i.rlike(identity.RELIABLE).alias("reliable"), i.rlike(identity.ORPHAN).alias("orphan"))


@query(P + f"SELECT CASE WHEN regexp_matches(id, '{identity.WEIRD}') THEN 'weird' WHEN regexp_matches(id, '{identity.RELIABLE}') THEN 'reliable' ELSE 'other' END AS class, count(*) AS n FROM p GROUP BY 1")
def agg_13(spark, sf_dir):
    kind = F.when(c("id").rlike(identity.WEIRD), "weird").when(c("id").rlike(identity.RELIABLE), "reliable").otherwise("other")
    return papers(spark, sf_dir).groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query(P + "SELECT id, length(title) < 40 OR NOT regexp_matches(right(trim(title), 1), '[A-Za-z0-9.?!]') AS truncated FROM p")
def flt_18(spark, sf_dir):
    return papers(spark, sf_dir).select("id", identity.truncated_title(c("title")).alias("truncated"))


@query(P + ", y AS (SELECT id, trim(coalesce(year, '')) AS y, translate(coalesce(doi, ''), '/-', '') AS d FROM p) SELECT id, NOT regexp_matches(y, '^[0-9]+$') OR coalesce(try_cast(y AS INTEGER) NOT BETWEEN 1950 AND 2035, true) OR (d <> '' AND contains(d, y)) AS poisoned FROM y")
def flt_19(spark, sf_dir):
    return papers(spark, sf_dir).select("id", identity.poisoned_year(c("year"), c("doi")).alias("poisoned"))


@query(P + ", t AS (SELECT *, trim(coalesce(title, '')) AS t, len(list_filter(string_split(authors, ';'), lambda x: length(trim(x)) > 2)) > 0 AS named FROM p) SELECT id, length(t) >= 12 AND named AND (coalesce(CASE WHEN regexp_matches(trim(year), '^[0-9]{4}$') THEN year::INTEGER BETWEEN 1950 AND 2035 ELSE false END, false) OR length(trim(coalesce(doi, ''))) >= 8) AS usable FROM t")
def flt_20(spark, sf_dir):
    return papers(spark, sf_dir).select("id", identity.usable(c("title"), F.split("authors", ";"), c("year"), c("doi"), F.lit(False)).alias("usable"))


STAGED = View("pages", {"page_id": "page_id", "name": f"upper({word(1, 'regexp_extract(html, ' + chr(39) + '<title>([^<]*)' + chr(39) + ', 1)')}) || '_' || (page_id % 7) || '_' || (page_id % 5) || '.pdf'"})


@query(P + f", {STAGED.sql('s')}, o AS (SELECT unnest([lower(original), lower(renamed)]) AS n FROM p) SELECT page_id, name FROM s WHERE lower(name) IN (SELECT n FROM o)")
def jn_04(spark, sf_dir):
    """Staged files (named after pages' titles) whose name the catalogue has under either name."""
    names = papers(spark, sf_dir).select(F.explode(F.array(F.lower("original"), F.lower("renamed"))).alias("n")).filter("n <> ''")
    return STAGED.df(spark, sf_dir).join(names, F.lower("name") == c("n"), "left_semi")


@query(P + ", o AS (SELECT id AS child, regexp_replace(id, '_supplement$', '') AS stem FROM p WHERE regexp_matches(id, '_supplement$')) SELECT child, p.id AS parent FROM o JOIN p ON p.id = stem")
def jn_10(spark, sf_dir):
    """Orphan supplements and the parent that their id without its suffix names (first tier)."""
    o = papers(spark, sf_dir).filter(c("id").rlike("_supplement$")).select(c("id").alias("child"), F.regexp_replace("id", "_supplement$", "").alias("stem"))
    return o.join(papers(spark, sf_dir).select(c("id").alias("parent")), c("stem") == c("parent")).select("child", "parent")


_NAME = "lower(regexp_replace(trim(split_part(a, ',', 1)), '^((van|von|de|del|der|den|di|le|la) )+', ''))"


@query(P + f", a AS (SELECT id, year, unnest(string_split(authors, ';')) AS a FROM p), n AS (SELECT DISTINCT id, year, {_NAME} AS surname FROM a WHERE a <> ''), f AS (SELECT year, surname, min(id) AS first_id FROM n GROUP BY 1, 2) SELECT n.id, f.first_id, n.surname FROM n JOIN f ON n.surname = f.surname AND n.year = f.year AND n.id <> f.first_id")
def jn_20(spark, sf_dir):
    """Rows that share a year and an author's surname, particles aside: each with the first of its group, not each with each (also JN-12)."""
    a = papers(spark, sf_dir).select("id", "year", F.explode(F.split("authors", ";")).alias("a")).filter("a <> ''")
    name = F.lower(F.regexp_replace(F.trim(F.split_part("a", F.lit(","), F.lit(1))), "^((van|von|de|del|der|den|di|le|la) )+", ""))
    n = a.select("id", "year", name.alias("surname")).distinct()
    first = n.groupBy("year", "surname").agg(F.min("id").alias("first_id"))
    return n.join(first, ["year", "surname"]).filter("id <> first_id").select("id", "first_id", "surname")


_RICH = "(length(coalesce(title, '')) + CASE WHEN authors = '' THEN 0 ELSE 10 * len(string_split(authors, ';')) END + CASE WHEN trim(coalesce(year, '')) <> '' THEN 5 ELSE 0 END + CASE WHEN trim(coalesce(doi, '')) <> '' THEN 20 ELSE 0 END + length(abstract) // 10 + CASE WHEN tags = '' THEN 0 ELSE len(string_split(tags, ',')) END + CASE WHEN trim(coalesce(rating, '')) <> '' THEN 50 ELSE 0 END + CASE WHEN coalesce(survived, false) THEN 50 ELSE 0 END)::INTEGER"


def _rich(spark, sf_dir):
    lists = lambda col, sep: F.when(c(col) != "", F.split(col, sep))
    score = identity.richness(c("title"), lists("authors", ";"), c("year"), c("doi"), c("abstract"), lists("tags", ","), c("rating"), c("survived"))
    return papers(spark, sf_dir).withColumn("score", score).withColumn("key", text.norm_sp(F.coalesce(c("doi"), c("id"))))


@query(P + f"SELECT id, {_RICH} AS score FROM p")
def top_06_scores(spark, sf_dir):
    return _rich(spark, sf_dir).select("id", "score")


@query(P + f", s AS (SELECT id, {_RICH} AS score, {sql_norm('coalesce(doi, id)')} AS key FROM p) SELECT key, id FROM s WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, id) = 1")
def top_06(spark, sf_dir):
    """The richest row of each DOI."""
    rows = _rich(spark, sf_dir).filter("key <> ''").select("key", "id", "score")
    return dedup.survivors(rows, ["key"], -c("score"), c("id")).select("key", "id")


@query(P + f""", s AS (SELECT *, {_RICH} AS score, {sql_norm('coalesce(doi, id)')} AS key FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, id) AS rn FROM s WHERE key <> '')
SELECT key, max(id) FILTER (rn = 1) AS id, coalesce(max(nullif(journal, '')) FILTER (rn = 1), max(nullif(journal, ''))) AS journal, coalesce(max(nullif(venue, '')) FILTER (rn = 1), max(nullif(venue, ''))) AS venue FROM o GROUP BY 1""")
def w_06(spark, sf_dir):
    """Rows of one DOI merged: the richest row's fields win where it has them."""
    w = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    o = _rich(spark, sf_dir).filter("key <> ''").withColumn("rn", F.row_number().over(w))
    first = lambda col: F.min_by(text.nz(c(col)), F.when(text.nz(c(col)).isNotNull(), c("rn"))).alias(col)
    return o.groupBy("key").agg(F.min_by("id", "rn").alias("id"), first("journal"), first("venue"))


_QUALITY = "(CASE WHEN starts_with(lower(renamed), '1-s2.0-') OR starts_with(lower(renamed), '1_s2_0_') THEN 1000 ELSE 0 END + CASE WHEN contains(lower(renamed), 'unknown_unknown') THEN 2000 ELSE 0 END + CASE WHEN regexp_matches(renamed, '\\([0-9]\\)') THEN 500 ELSE 0 END + CASE WHEN contains(renamed, '_main') THEN 200 ELSE 0 END - CASE WHEN regexp_matches(renamed, '^[a-z]+_[0-9]{4}_') THEN 500 ELSE 0 END - CASE WHEN regexp_matches(renamed, '^[a-z]+_[a-z]+_') THEN 100 ELSE 0 END + length(renamed))::INTEGER"


@query(P + f"SELECT id, {_QUALITY} AS score FROM p")
def top_05_names(spark, sf_dir):
    return papers(spark, sf_dir).select("id", identity.name_quality(c("renamed")).alias("score"))


@query(P + "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(tags, ',')) AS tag FROM p WHERE tags <> '') GROUP BY 1")
def agg_12_tags(spark, sf_dir):
    return papers(spark, sf_dir).filter("tags <> ''").select(F.explode(F.split("tags", ",")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(P + "SELECT a.id, array_to_string(list_sort(list_distinct(string_split(a.tags, ',') || string_split(b.tags, ','))), ',') AS tags FROM p a JOIN p b ON b.id = replace(a.id, '_supplement', '') WHERE a.kind = 'supplement'")
def set_01(spark, sf_dir):
    """Tags of supplements united with their papers'."""
    p = papers(spark, sf_dir)
    parent = p.select(c("id").alias("parent"), c("tags").alias("more"))
    rows = p.filter("kind = 'supplement'").join(parent, F.replace("id", F.lit("_supplement"), F.lit("")) == c("parent"))
    return rows.select("id", F.array_join(F.array_sort(F.array_union(F.split("tags", ","), F.split("more", ","))), ",").alias("tags"))


@query(P + "SELECT id, title, array_to_string(string_split(authors, ';'), '; ') AS authors FROM p WHERE chars > 0")
def snk_11(spark, sf_dir):
    """The ledger row's projection: authors joined, blank columns kept blank."""
    return papers(spark, sf_dir).filter("chars > 0").select("id", "title", F.array_join(F.split("authors", ";"), "; ").alias("authors"))


@query(P + "SELECT count(*) FILTER (chars > 0) AS rows_with_text, count(*) AS rows_all, sum(chars)::BIGINT AS chars FROM p")
def snk_10(spark, sf_dir):
    """What an export would write, without writing it."""
    return papers(spark, sf_dir).agg(F.count_if(c("chars") > 0).alias("rows_with_text"), F.count("*").alias("rows_all"), F.sum("chars").alias("chars"))


@query(P + "SELECT status, count(*) AS n, min(id) AS example FROM p GROUP BY 1")
def agg_06(spark, sf_dir):
    return papers(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.min("id").alias("example"))


@query(P + "SELECT count(*) AS total, count(*) FILTER (chars > 50000) AS likely, count(*) FILTER (rating IS NOT NULL AND rating NOT IN ('', 'NO_RATING')) AS rated FROM p")
def agg_14(spark, sf_dir):
    rated = c("rating").isNotNull() & ~c("rating").isin("", "NO_RATING")
    return papers(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(c("chars") > 50000).alias("likely"), F.count_if(rated).alias("rated"))


@query(P + "SELECT id, lower(split_part(authors, ',', 1)) || '_' || year AS prefix, CASE WHEN year IS NULL OR NOT regexp_matches(year, '^[0-9]+$') THEN 'unknown_year' WHEN year::INTEGER < 1990 THEN 'pre_1990' WHEN year::INTEGER < 2010 THEN '1990_2009' WHEN year::INTEGER < 2020 THEN '2010_2019' ELSE '2020_plus' END AS era FROM p")
def d_02_papers(spark, sf_dir):
    number = F.when(c("year").rlike("^[0-9]+$"), c("year").cast("int"))
    prefix = F.concat(F.lower(F.split_part("authors", F.lit(","), F.lit(1))), F.lit("_"), "year")
    return papers(spark, sf_dir).select("id", prefix.alias("prefix"), identity.era(number).alias("era"))


SIGNALS = View(
    "labelled",
    {
        "k": "doc_id",
        "signals": "concat_ws('|', CASE WHEN n_chars % 7 = 0 THEN 'content_hash' END, CASE WHEN lang = 'fr' THEN 'doi' END, CASE WHEN quality = 1 THEN 'author' END, "
        "CASE WHEN toxic = 0 THEN 'title_' || (85 + n_chars % 15) END, CASE WHEN n_chars % 2 = 0 THEN 'year' END, CASE WHEN n_chars % 5 = 0 THEN 'abstract_' || (80 + n_chars % 20) END)",
    },
)


@query(f"""WITH {SIGNALS.sql('t')}, s AS (SELECT k, CASE WHEN signals = '' THEN [] ELSE string_split(signals, '|') END AS s, signals FROM t)
SELECT k, list_contains(s, 'content_hash') OR (list_contains(s, 'doi') AND len(s) >= 2) OR (list_contains(s, 'author') AND contains(signals, 'title_') AND (list_contains(s, 'year') OR contains(signals, 'abstract_'))) AS confirmed FROM s""")
def c_23(spark, sf_dir):
    s = F.when(c("signals") != "", F.split("signals", r"\|")).otherwise(F.array().cast("array<string>"))
    return SIGNALS.df(spark, sf_dir).select("k", identity.signals_confirm(s).alias("confirmed"))


@query(f"WITH {SIGNALS.sql('t')} SELECT k, CASE WHEN starts_with(signals, 'content_hash') THEN 'confirmed' WHEN signals <> '' THEN 'ambiguous' ELSE 'none' END AS confidence FROM t")
def c_21(spark, sf_dir):
    s = c("signals")
    return SIGNALS.df(spark, sf_dir).select("k", F.when(s.startswith("content_hash"), "confirmed").when(s != "", "ambiguous").otherwise("none").alias("confidence"))


CLASSES = View("documents", {"k": "doc_id", "class": pick("n_chars", [n for names in identity.DISPOSITION.values() for n in names] + ["SOMETHING_ELSE"])})


@query(f"WITH {CLASSES.sql('t')} SELECT k, CASE " + " ".join(f"WHEN class IN ({', '.join(repr(n) for n in names)}) THEN '{kind}'" for kind, names in identity.DISPOSITION.items()) + " ELSE 'MODEL_RECOVERY' END AS disposition FROM t")
def c_10(spark, sf_dir):
    return CLASSES.df(spark, sf_dir).select("k", identity.disposition(c("class")).alias("disposition"))


ACTIONS = View("documents", {"k": "doc_id", "action": pick("n_chars", list(identity.TERMINAL)), "confidence": "cast(50 + doc_id % 50 AS DOUBLE) / 100"})


@query(f"WITH {ACTIONS.sql('t')} SELECT k, CASE action " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in identity.TERMINAL.items()) + " END AS terminal, confidence < CASE WHEN starts_with(action, 'DELETE') THEN 0.95 ELSE 0.7 END AS second_opinion FROM t")
def c_11(spark, sf_dir):
    """Public action names, and which need a second opinion (FLT-36)."""
    return ACTIONS.df(spark, sf_dir).select("k", identity.lookup(c("action"), identity.TERMINAL).alias("terminal"), identity.second_opinion(c("action"), c("confidence")).alias("second_opinion"))


LIGHTS = View("documents", {"k": "doc_id", "value": pick("n_chars", ["Green", " red ", "No problems detected", "something to check", "odd", "", "NA", None]) })


@query(f"WITH {LIGHTS.sql('t')} SELECT k, coalesce(CASE lower(trim(value)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in identity.LIGHTS.items()) + " END, '') AS light FROM t")
def c_34(spark, sf_dir):
    return LIGHTS.df(spark, sf_dir).select("k", identity.lookup(F.lower(F.trim("value")), identity.LIGHTS, "").alias("light"))


RETRIES = View(
    "events",
    {
        "k": "event_id", "tries": "CASE WHEN event_type = 'error' THEN NULL ELSE cast(user_id % 4 AS INT) END", "last": "CASE WHEN user_id % 5 = 0 THEN '' WHEN user_id % 7 <> 0 THEN event_type END",
        "reason": "CASE WHEN event_id % 3 = 0 THEN 'error' ELSE event_type END", "seconds": "CASE WHEN value > 0 THEN value * 100 - 50 END", "usd": "value", "rate": "CASE WHEN user_id % 9 > 0 THEN cast(user_id % 9 AS DOUBLE) - 1 END",
    },
)


@query(f"WITH {RETRIES.sql('t')} SELECT k, coalesce(tries, 0) >= 1 AND ((coalesce(last, '') <> '' AND last = reason) OR coalesce(tries, 0) >= 2) AS blocked FROM t")
def flt_28(spark, sf_dir):
    return RETRIES.df(spark, sf_dir).select("k", F.coalesce(identity.blocked_retry(c("tries"), c("last"), c("reason")), F.lit(False)).alias("blocked"))


@query(f"""WITH {RETRIES.sql('t')}, s AS (SELECT *, floor(seconds)::INTEGER AS s FROM t)
SELECT k, CASE WHEN seconds IS NULL OR seconds < 0 THEN 'unknown' WHEN s >= 3600 THEN (s // 3600) || 'h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm'
  WHEN s >= 60 THEN (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s || 's' END AS took, CASE WHEN rate > 0 THEN round(usd * rate, 2) END AS local FROM s""")
def d_03(spark, sf_dir):
    """Durations in words, and amounts in another currency (M-02)."""
    return RETRIES.df(spark, sf_dir).select("k", identity.duration(c("seconds")).alias("took"), identity.in_currency(c("usd"), c("rate")).alias("local"))


GUARDS = View(
    "labelled",
    {
        "k": "doc_id", "rating": pick("n_chars", ["not_ratable_reference_material", "not-applicable", "not_applicable", "strong", None, "Not_Applicable", "not applicable"]), "journal": "cast(doc_id % 4 AS INT)",
        "reference": "cast(coalesce(quality, 2) AS INT)", "insufficient": "cast(coalesce(toxic, 0) AS INT)",
    },
)


@query(f"""WITH {GUARDS.sql('t')}, r AS (SELECT *, replace(lower(coalesce(rating, '')), '-', '_') AS r FROM t)
SELECT k, CASE WHEN journal >= 2 AND reference <= 1 AND r IN ('not_ratable_reference_material', 'not_applicable', 'not applicable') THEN 'blocked:insufficient_evidence'
  WHEN r = 'not_applicable' AND insufficient >= 1 AND journal >= 1 THEN 'blocked:identity_or_extraction_problem' ELSE 'allowed' END AS verdict FROM r""")
def c_19(spark, sf_dir):
    return GUARDS.df(spark, sf_dir).select("k", identity.article_guard(c("rating"), c("journal"), c("reference"), c("insufficient")).alias("verdict"))
