"""Queries over the order tables and over literal names: search, links, ids, file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import gates, text
from vellum.operators import dedup, linkage, retrieval
from vellum.plans.common import Literal, View, pick, sql_norm, word
from vellum.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_PART = "(contains(lower(p_name), 'a1') OR contains(lower(p_brand), 'a1') OR contains(lower(p_type), 'a1') OR contains(lower(p_name), '1'))"


@query("""WITH f AS (SELECT p_partkey, p_brand, p_size FROM part WHERE (contains(lower(p_name), '1') OR contains(lower(p_brand), '1') OR contains(lower(p_type), '1'))
  AND lower(coalesce(p_brand, '')) = lower((SELECT min(p_brand) FROM part)) ORDER BY p_partkey LIMIT 80)
SELECT * FROM f WHERE p_size BETWEEN 5 AND 40 ORDER BY p_partkey LIMIT 20""")
def top_01(spark, sf_dir):
    """Structured search: cut to four times the width, then the late range filter."""
    p = table(spark, sf_dir, "part")
    brand = p.agg(F.min("p_brand")).first()[0]
    found = retrieval.structured_search(p, "1", ["p_name", "p_brand", "p_type"], "p_partkey", 20, {"p_brand": brand}, F.col("p_size").between(5, 40))
    return found.select("p_partkey", "p_brand", "p_size")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), '7') OR contains(lower(p_brand), '7') OR contains(lower(p_type), '7')")
def flt_05(spark, sf_dir):
    any_of = F.lit(False)
    for c in ("p_name", "p_brand", "p_type"):
        any_of = any_of | F.contains(F.lower(c), F.lit("7"))
    return table(spark, sf_dir, "part").filter(any_of).select("p_partkey")


@query("""SELECT p_partkey, score FROM (SELECT p_partkey, p_name, (CASE WHEN contains(lower(p_name), '2') THEN 3 ELSE 1 END + CASE WHEN contains(lower(p_brand), '2') THEN 2 ELSE 0 END)::INTEGER AS score
  FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), '2')) ORDER BY score DESC, p_name, p_partkey LIMIT 50""")
def top_02(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("title", F.concat(F.col("p_name"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")))
    found = retrieval.haystack_search(p.withColumn("title", F.col("p_name")), "2", "title", "p_brand", ["p_type"], 1 << 30)
    return found.orderBy(F.desc("score"), "p_name", "p_partkey").limit(50).select("p_partkey", "score")


@query("SELECT o_orderkey, CASE WHEN y < 1993 THEN 'early' WHEN y < 1995 THEN 'middle' WHEN y < 1997 THEN 'late' ELSE 'recent' END AS era FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)")
def d_02(spark, sf_dir):
    y = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(y < 1993, "early").when(y < 1995, "middle").when(y < 1997, "late").otherwise("recent").alias("era"))


WEIGHTS = Literal("era string, weight double", [("early", 0.2), ("middle", 0.5), ("late", 0.8), ("recent", 1.0)])


@query(f"WITH {WEIGHTS.sql('w')}, o AS ({ORACLE['d_02']}) SELECT o.era, count(*) AS n, sum(weight) AS weight FROM o JOIN w ON o.era = w.era GROUP BY 1")
def c_33(spark, sf_dir):
    """Weights looked up in a fixed table of four rows."""
    return d_02(spark, sf_dir).join(F.broadcast(WEIGHTS.df(spark)), "era").groupBy("era").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


_THREE = """WITH f AS (SELECT s_suppkey AS f_id, s_nationkey AS f_nation, s_suppkey % 97 AS f_code, lower(right(s_name, 4)) AS f_name FROM supplier),
r AS (SELECT c_custkey AS r_id, c_nationkey * 7 AS r_nation, c_custkey AS r_code, lower(right(c_name, 4)) AS r_name FROM customer),
m AS (SELECT f_id, r_id, 'nation' AS match_type FROM f JOIN r ON f_nation = r_nation UNION ALL SELECT f_id, r_id, 'code' FROM f JOIN r ON f_code = r_code
  UNION ALL SELECT f_id, r_id, 'name' FROM f JOIN r ON f_name = r_name)
"""


def _three(spark, sf_dir):
    f = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("f_id"), F.col("s_nationkey").alias("f_nation"), (F.col("s_suppkey") % 97).alias("f_code"), F.lower(F.right("s_name", F.lit(4))).alias("f_name")
    )
    r = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("r_id"), (F.col("c_nationkey") * 7).alias("r_nation"), F.col("c_custkey").alias("r_code"), F.lower(F.right("c_name", F.lit(4))).alias("r_name")
    )
    return f, r


@query(_THREE + "SELECT match_type, count(*) AS n, count(DISTINCT f_id) AS files FROM m GROUP BY 1")
def jn_17(spark, sf_dir):
    return linkage.three_way_counts(*_three(spark, sf_dir), ["nation", "code", "name"])


_PAGE_TITLE = "regexp_extract(html, '<title>([^<]*)', 1)"
_PAGE_NUMBER = "regexp_extract(url, '/([0-9]+)', 1)"
#: Pages as files: some by the path of their document, some by its digest, the others by names that several have.
OWNED = View(
    "pages",
    {
        "f_id": "page_id", "path": f"CASE WHEN page_id % 5 = 0 THEN 'Src/' || {_PAGE_NUMBER} || '.pdf' ELSE '' END", "sha": f"CASE WHEN page_id % 5 = 1 THEN SHA<{_PAGE_TITLE}>SHA ELSE '' END",
        "name": f"CASE WHEN page_id % 5 = 4 THEN lower({word(1, _PAGE_TITLE)}) || '_' || {_PAGE_NUMBER} || '_supplement.pdf' WHEN page_id % 5 > 1 THEN {word(1, _PAGE_TITLE)} || '.pdf' ELSE '' END",
    },
)
CLAIMS = View(
    "documents",
    {
        "r_id": f"lower({word(1)}) || '_' || doc_id", "field": pick("doc_id", ["file_info.renamed_filename", "file_info.original_filename", "supplements.items[0].filename", "x.filename"]), "weak": "doc_id % 11 = 0",
        "path": "CASE WHEN doc_id % 3 = 0 THEN 'src/' || doc_id || '.pdf' ELSE '' END", "sha": "CASE WHEN doc_id % 2 = 0 THEN SHA<substring(split_part(text, chr(10), 1), 1, 60)>SHA ELSE '' END",
        "name": f"CASE WHEN doc_id % 4 = 1 THEN upper({word(1)}) || '.pdf' ELSE lower({word(1)}) || '_' || (doc_id - doc_id % 2) || '_supplement.pdf' END",
    },
)
_OWNERS = f"""WITH {OWNED.sql('fv')}, {CLAIMS.sql('rv')}, f AS (SELECT f_id, lower(path) AS path, lower(sha) AS sha, lower(name) AS name FROM fv), r AS (SELECT r_id, field, weak, lower(path) AS path, lower(sha) AS sha, lower(name) AS name FROM rv),
m AS (SELECT f_id, f.name, r_id, field, weak, k AS by_key FROM f, r, (SELECT unnest(['path', 'sha', 'name']) AS k) WHERE (k = 'path' AND f.path <> '' AND f.path = r.path) OR (k = 'sha' AND f.sha <> '' AND f.sha = r.sha) OR (k = 'name' AND f.name <> '' AND f.name = r.name)),
n AS (SELECT f_id, count(DISTINCT r_id) FILTER (NOT weak) AS owners, count(*) AS every FROM m GROUP BY 1),
s AS (SELECT m.f_id, name, r_id, sum(CASE WHEN ends_with(field, '.filename') AND NOT ends_with(field, '.original_filename') THEN 5 ELSE 0 END + CASE WHEN contains(field, 'items[') AND contains(field, '.filename') THEN 4 ELSE 0 END)
    + CASE WHEN starts_with(name, r_id) THEN 10 ELSE 0 END + CASE WHEN split_part(r_id, '_', 1) <> '' AND contains(name, split_part(r_id, '_', 1)) THEN 3 ELSE 0 END AS score
  FROM m JOIN n ON m.f_id = n.f_id WHERE NOT weak AND owners > 1 AND regexp_matches(name, 'supp|appendix|corrig|erratum|addendum|retraction') GROUP BY 1, 2, 3),
w AS (SELECT f_id, r_id FROM s QUALIFY score = max(score) OVER (PARTITION BY f_id) AND count(*) OVER (PARTITION BY f_id, score) = 1),
g AS (SELECT m.* FROM m LEFT JOIN w ON m.f_id = w.f_id WHERE NOT weak AND (w.r_id IS NULL OR w.r_id = m.r_id)),
c AS (SELECT f_id, bool_or(by_key = 'path') AS p, bool_or(by_key = 'sha') AS h, count(DISTINCT r_id) AS owners, min(r_id) AS owner FROM g GROUP BY 1)
"""
_CLASS = """CASE WHEN p THEN 'owned_canonical_path' WHEN h THEN 'owned_hash_exact' WHEN c.owners = 1 THEN 'owned_filename_exact' WHEN c.owners > 1 THEN 'ambiguous_multi_match'
  WHEN n.every > 0 THEN 'unresolved_insufficient_evidence' ELSE 'unowned_no_match' END AS class"""
_CLASSED = f"SELECT f.f_id, {_CLASS}, CASE WHEN c.owners = 1 THEN owner END AS owner FROM f LEFT JOIN c ON f.f_id = c.f_id LEFT JOIN n ON f.f_id = n.f_id"


@query(_OWNERS + _CLASSED)
def c_31(spark, sf_dir):
    """The six classes of ownership, and the owner where there is one."""
    return linkage.file_owners(OWNED.df(spark, sf_dir), CLAIMS.df(spark, sf_dir))


@query(_OWNERS + f", x AS ({_CLASSED}) SELECT class, count(*) AS n, count(owner) AS with_owner FROM x GROUP BY 1")
def agg_08(spark, sf_dir):
    return c_31(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"), F.count("owner").alias("with_owner"))


@query("SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2")
def agg_10(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.countDistinct("l_suppkey").alias("owners")).filter("owners >= 2")


@query("SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS refs FROM part")
def agg_11(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = table(spark, sf_dir, "part").select("p_partkey")
    return p.join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("refs"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rn FROM orders)
SELECT * FROM o WHERE rn <= 3""")
def win_11(spark, sf_dir):
    """Up to three examples per category."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return dedup.ranked(o, ["o_custkey"], 3, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("""WITH b AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS base FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM b)
SELECT p_partkey, CASE WHEN n = 1 THEN base WHEN n <= 16 THEN base || '_' || chr((96 + n)::INTEGER) ELSE base || '_' || (n - 15) END AS new_id FROM n""")
def win_07(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("base"))
    return linkage.suffixed(p, "base", "p_partkey").select("p_partkey", "new_id")


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000")
def jn_21(spark, sf_dir):
    """Hits enriched by two lookups."""
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return o.join(c, "o_custkey", "left").join(n, "n_nationkey", "left").select("o_orderkey", "c_name", "n_name")


# Names of files: words of the texts before and after what names carry.
_PARTS = ["Smith_2001_Rhythm supplement.pdf", "thesis-final.pdf", "Oxford Handbook chapter 3.pdf", "Handbook of X (editor).pdf", "Routledge.pdf", "poster_7.pdf", "Author) unknown.pdf",
     "study protocol v2.pdf", "Jones - On Time (1998).pdf", "review-2004-music.pdf", "barry_1991_rhythm.pdf", "1-s2.0-s0167.pdf", "Erratum to Barry.pdf", "Retracted- A.pdf", "corrected proof.pdf",
     "appendix_a.docx", "mmc1.pdf", "expression_of concern.pdf", "CON", "aux", "A:B/C*D?E\"F<G>H|I", "a & b + c", "x-20240101-101010", "name_1_2_3_4", "file copy", "__", "plain title of a paper", "report-copy-copy", "v1.2.3"]
NAMES = View("documents", {"k": "doc_id", "name": f"CASE WHEN doc_id % 3 = 0 THEN {word(1)} || '_' || (1900 + n_chars % 150) || '_' ELSE '' END || {pick('n_chars', _PARTS)} || CASE WHEN doc_id % 5 = 0 THEN ' ' || {word(2)} ELSE '' END"})


@query(f"""WITH {NAMES.sql('t')}, l AS (SELECT *, lower(name) AS low FROM t), b AS (SELECT *, regexp_matches(low, '{gates.BOOK}') AS book, regexp_matches(low, '[-_](19|20)[0-9]{{2}}[-_][a-z]') AS dated FROM l)
SELECT k, CASE WHEN regexp_matches(low, '{gates.SUPPLEMENT}') THEN 'supplement' WHEN regexp_matches(low, 'thesis|dissertation') THEN 'thesis'
  WHEN book THEN CASE WHEN contains(low, 'chapter') THEN 'book_chapter' WHEN contains(low, 'editor') THEN 'edited_volume' ELSE 'book' END
  WHEN regexp_matches(low, 'poster|conference abstract|abstract book') THEN 'poster_or_abstract' WHEN contains(low, 'author)') OR starts_with(low, 'author') THEN 'other_or_unknown'
  WHEN regexp_matches(low, 'protocol|registered report') THEN 'protocol' WHEN regexp_matches(name, '\\s-\\s.+\\((19|20)[0-9]{{2}}\\)') THEN 'book'
  WHEN contains(low, 'review') AND dated THEN 'review_article' WHEN dated THEN 'journal_article' ELSE 'other_or_unknown' END AS kind FROM b""")
def c_02(spark, sf_dir):
    return NAMES.df(spark, sf_dir).select("k", gates.kind_of_name(F.col("name")).alias("kind"))


@query(f"WITH {NAMES.sql('t')} SELECT k, CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{p}') THEN '{kind}'" for kind, p in gates.CHILD) + " END AS kind FROM t")
def c_06(spark, sf_dir):
    return NAMES.df(spark, sf_dir).select("k", gates.child_kind(F.col("name")).alias("kind"))


_FILE = "regexp_replace(regexp_replace(replace(replace(lower(trim(name)), '&', ' and '), '+', ' plus '), '[^a-z0-9_.-]+', '_', 'g'), '_+', '_', 'g')"
for _ in range(3):
    _FILE = f"regexp_replace(regexp_replace({_FILE}, '([_-]([0-9]{{8}}-[0-9]{{6}}|[0-9]{{7,}}))+$', ''), '([_-][0-9]{{1,4}}){{3,}}$', '')"
_FILE = f"regexp_replace(regexp_replace({_FILE}, '([_-](retry|copy|duplicate|recovered|staging))*$', ''), '^[._ -]+|[._ -]+$', '', 'g')"


@query(f"""WITH {NAMES.sql('t')}, s AS (SELECT k, CASE WHEN {_FILE} = '' THEN 'file' ELSE {_FILE} END AS x FROM t)
SELECT k, CASE WHEN regexp_full_match(split_part(x, '.', 1), '(con|prn|aux|nul|com[1-9]|lpt[1-9])') THEN x || '_file' ELSE x END AS safe FROM s""")
def s_17(spark, sf_dir):
    return NAMES.df(spark, sf_dir).select("k", text.file_name(F.col("name")).alias("safe"))


@query()
def flt_32(spark, sf_dir):
    n = F.col("name")
    return NAMES.df(spark, sf_dir).select("k", gates.path_problems(n, n, text.file_name(n)).alias("problems"))


@query(f"WITH {NAMES.sql('t')} SELECT k, {sql_norm('name')} AS norm, lower(list_last(regexp_split_to_array(trim(name), '\\s+'))) AS surname FROM t")
def s_08(spark, sf_dir):
    return NAMES.df(spark, sf_dir).select("k", text.norm_sp(F.col("name")).alias("norm"), text.surname(F.col("name")).alias("surname"))


TITLES = View(
    "documents",
    {
        "k": "doc_id",
        "title": f"CASE n_chars % 12 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN {word(1)} || '_' || doc_id WHEN 3 THEN substring(text, 1, 6) WHEN 4 THEN substring(text, 1, 20) || '.PDF' WHEN 5 THEN cast(100000000 + doc_id AS STRING) "
        f"WHEN 6 THEN {word(1)} WHEN 7 THEN {word(1)} || {word(2)} || {word(3)} WHEN 8 THEN {word(1)} || '_' || {word(2)} || '_10_10' WHEN 9 THEN repeat('x', 70) || '_' || doc_id ELSE substring(split_part(text, chr(10), 1), 1, 90) END",
        "id": f"lower({word(1)}) || '_' || doc_id", "surname": f"lower({word(1)})",
    },
)


@query(f"""WITH {TITLES.sql('t')}, n AS (SELECT *, trim(coalesce(title, '')) AS x FROM t)
SELECT k, CASE WHEN x = '' THEN 'T1_empty' WHEN lower(x) = lower(id) THEN 'T2_equals_id' WHEN length(x) < 8 THEN 'T3_too_short' WHEN regexp_matches(lower(x), '\\.(pdf|docx?|indd)$') THEN 'T5_file_ext'
  WHEN regexp_matches(x, '^[0-9]+$') THEN 'T5_pure_digits' WHEN lower(x) = surname THEN 'T6_just_surname' WHEN NOT contains(x, ' ') AND NOT contains(x, '_') AND regexp_matches(x, '^[A-Za-z]+$') THEN 'T4_camel_no_space'
  WHEN NOT contains(x, ' ') AND contains(x, '_') AND length(x) < 60 THEN 'T4b_underscored_no_spaces' END AS reason FROM n""")
def flt_16(spark, sf_dir):
    c = F.col
    return TITLES.df(spark, sf_dir).select("k", gates.broken_title(c("title"), c("id"), c("surname")).alias("reason"))


TEXTS = View(
    "documents",
    {
        "k": "doc_id",
        "t": f"substring(text, 1, 200) || CASE n_chars % 6 WHEN 0 THEN ' see https://doi.org/10.' || (1000 + doc_id) || '/AB.c-' || source || '). Then' WHEN 1 THEN ' doi:10.5555/' || {word(1)} || '(1)y; 1998' WHEN 2 THEN ' none ' || (1990 + doc_id % 40) || ' and 1999' "
        "WHEN 3 THEN ' 10.12/short' WHEN 4 THEN ' Published 1899, again 2050' ELSE '' END",
    },
)


@query(f"""WITH {TEXTS.sql('t0')}, d AS (SELECT *, regexp_replace(regexp_extract(lower(t), '(10\\.[0-9]{{4,9}}/[-._;()/:a-z0-9]+)', 1), '[.,;:)]+$', '') AS x, regexp_extract(t, '((?:19|20)[0-9]{{2}})', 1) AS y FROM t0)
SELECT k, nullif(x, '') AS doi, try_cast(nullif(y, '') AS INTEGER) AS year FROM d""")
def s_33(spark, sf_dir):
    return TEXTS.df(spark, sf_dir).select("k", text.doi(F.col("t")).alias("doi"), text.year(F.col("t")).alias("year"))


STATUSES = View("documents", {"k": "doc_id", "status": pick("n_chars", ["EXTRACTOR_UNAVAILABLE", "EXTRACTOR_CRASHED", "OCR_FAILED", "OCR_REQUIRED", "TRUE_EMPTY_TEXT", "CORRUPT_OR_UNREADABLE", "UNSUPPORTED_CONTENT_TYPE", "TEXT_OK", "WRONG_PATH_OR_MISSING_FILE"])})


@query(f"""WITH {STATUSES.sql('t')} SELECT k, CASE WHEN status IN ('EXTRACTOR_UNAVAILABLE', 'EXTRACTOR_CRASHED', 'WRONG_PATH_OR_MISSING_FILE', 'OCR_FAILED') THEN 'SYSTEM_INTEGRITY_FAILURE'
  WHEN status IN ('TRUE_EMPTY_TEXT', 'CORRUPT_OR_UNREADABLE') THEN 'DELETE_TRUE_CORRUPT_UNUSABLE' WHEN status = 'UNSUPPORTED_CONTENT_TYPE' THEN 'DELETE_CONFIRMED_JUNK'
  ELSE 'DELETE_UNRECOVERABLE_AFTER_FULL_ADJUDICATION' END AS action FROM t""")
def c_13(spark, sf_dir):
    return STATUSES.df(spark, sf_dir).select("k", gates.extraction_action(F.col("status")).alias("action"))
