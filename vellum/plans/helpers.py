"""Queries of the smaller helpers, over the literal catalogue and the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import identity, text
from vellum.operators import dedup, linkage
from vellum.plans.common import View, sql_norm
from vellum.plans.papers import P, papers
from vellum.sources.session import ensure_checkpoint_dir
from vellum.sources.tables import table

QUERIES, ORACLE = {}, {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(P + "SELECT id, lower(regexp_replace(trim(title), '\\s+', ' ', 'g')) AS t FROM p")
def s_07(spark, sf_dir):
    return papers(spark, sf_dir).select("id", F.lower(F.regexp_replace(F.trim("title"), r"\s+", " ")).alias("t"))


@query(P + "SELECT id, array_to_string(regexp_extract_all(id, '[A-Z][a-z]+'), ' ') AS words FROM p")
def s_09(spark, sf_dir):
    return papers(spark, sf_dir).select("id", F.array_join(F.regexp_extract_all("id", F.lit("[A-Z][a-z]+"), F.lit(0)), " ").alias("words"))


@query(P + "SELECT id, CASE WHEN regexp_matches(id, '__supplement$|_supplement_[0-9]+$|_[sS]upplement$|_supp[0-9]+$') THEN regexp_replace(id, '__supplement$|_supplement_[0-9]+$|_[sS]upplement$|_supp[0-9]+$', '') END AS base FROM p")
def s_13(spark, sf_dir):
    return papers(spark, sf_dir).select("id", F.when(c("id").rlike(identity.ORPHAN), F.regexp_replace("id", identity.ORPHAN, "")).alias("base"))


@query(P + "SELECT id, lower(regexp_extract(id, '^([A-Z][A-Za-z]+)_([0-9]{4})', 1)) AS author, regexp_extract(id, '^([A-Z][A-Za-z]+)_([0-9]{4})', 2) AS year FROM p")
def s_14(spark, sf_dir):
    part = lambda n: F.regexp_extract("id", "^([A-Z][A-Za-z]+)_([0-9]{4})", n)
    return papers(spark, sf_dir).select("id", F.lower(part(1)).alias("author"), part(2).alias("year"))


@query(P + "SELECT id, unnest([id || '.pdf', lower(id) || '.pdf', replace(id, '_', ' ') || '.pdf', replace(id, '_', '-') || '.pdf']) AS guess FROM p")
def s_15(spark, sf_dir):
    i, end = c("id"), F.lit(".pdf")
    guesses = [i, F.lower(i), F.replace(i, F.lit("_"), F.lit(" ")), F.replace(i, F.lit("_"), F.lit("-"))]
    return papers(spark, sf_dir).select("id", F.explode(F.array(*[F.concat(g, end) for g in guesses])).alias("guess"))


@query(P + "SELECT id, regexp_extract(id, '(S[0-9]{4})', 1) AS pii, regexp_replace(id, '_', ' ', 'g') AS title FROM p")
def s_16(spark, sf_dir):
    """The article code in an id, and the id as a title (S-22)."""
    return papers(spark, sf_dir).select("id", F.regexp_extract("id", "(S[0-9]{4})", 1).alias("pii"), F.regexp_replace("id", "_", " ").alias("title"))


@query(P + "SELECT id, trim(regexp_replace(lower(journal || ' ' || venue), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM p")
def s_23(spark, sf_dir):
    return papers(spark, sf_dir).select("id", F.trim(F.regexp_replace(F.lower(F.concat("journal", F.lit(" "), "venue")), "[^a-z0-9]+", "_"), F.lit("_")).alias("name"))


@query(P + ", w AS (SELECT id, title, list_filter(regexp_extract_all(lower(title), '[a-z]+'), lambda x: length(x) > 3 AND x NOT IN ('with', 'from', 'that', 'this')) AS w FROM p) SELECT id, CASE WHEN len(w) > 0 THEN w[1] END AS keyword FROM w")
def s_20(spark, sf_dir):
    """The first telling word of a title, as ids carry it."""
    words = F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0))
    return papers(spark, sf_dir).select("id", F.get(F.filter(words, lambda x: (F.length(x) > 3) & ~x.isin("with", "from", "that", "this")), F.lit(0)).alias("keyword"))


@query(P + "SELECT id, CASE WHEN length(abstract) > 100 THEN substring(abstract, 1, 99) || '…' ELSE abstract END AS short FROM p")
def s_29(spark, sf_dir):
    return papers(spark, sf_dir).select("id", F.when(F.length("abstract") > 100, F.concat(F.substring("abstract", 1, 99), F.lit("…"))).otherwise(c("abstract")).alias("short"))


@query(P + "SELECT id, regexp_replace(regexp_replace(original, '\\.[a-z0-9]+$', ''), '(_[0-9]+)+$', '') AS stem, coalesce(nullif(regexp_extract(lower(original), '\\.([a-z0-9]+)$', 1), ''), 'pdf') AS format FROM p")
def s_42(spark, sf_dir):
    """File stems without number chains, and formats by suffix (PRJ-09)."""
    ending = F.regexp_extract(F.lower("original"), r"\.([a-z0-9]+)$", 1)
    stem = F.regexp_replace(F.regexp_replace("original", r"\.[a-z0-9]+$", ""), "(_[0-9]+)+$", "")
    return papers(spark, sf_dir).select("id", stem.alias("stem"), F.coalesce(text.nz(ending), F.lit("pdf")).alias("format"))


@query(P + "SELECT id, array_to_string(list_transform(string_split(replace(authors, ';', '|'), '|')[1:2], lambda x: trim(x)), '; ') AS first_two, len(string_split(authors, ';'))::INTEGER AS n FROM p")
def l_01(spark, sf_dir):
    """Author lists from text, capped (L-02)."""
    a = F.transform(F.split("authors", ";"), lambda x: F.trim(x))
    return papers(spark, sf_dir).select("id", F.array_join(F.slice(a, 1, 2), "; ").alias("first_two"), F.size(a).alias("n"))


@query(P + "SELECT id, array_to_string(CASE WHEN list_contains(string_split(tags, ','), 'timing') THEN string_split(tags, ',') ELSE list_append(string_split(tags, ','), 'timing') END, ',') AS tags FROM p")
def l_03(spark, sf_dir):
    """Append where absent."""
    t = F.split("tags", ",")
    return papers(spark, sf_dir).select("id", F.array_join(F.when(F.array_contains(t, "timing"), t).otherwise(F.array_append(t, F.lit("timing"))), ",").alias("tags"))


@query(P + "SELECT id, array_to_string(list_append(list_filter(string_split(tags, ','), lambda x: x <> 'timing'), 'rhythm!'), ',') AS tags FROM p")
def l_04(spark, sf_dir):
    """Take matching items out, then append."""
    kept = F.filter(F.split("tags", ","), lambda x: x != "timing")
    return papers(spark, sf_dir).select("id", F.array_join(F.array_append(kept, F.lit("rhythm!")), ",").alias("tags"))


@query(P + "SELECT a.id, coalesce(nullif(a.journal, ''), b.journal) AS journal, coalesce(nullif(a.doi, ''), b.doi) AS doi FROM p a JOIN p b ON b.id = replace(a.id, '_supplement', '') WHERE a.kind = 'supplement'")
def l_05(spark, sf_dir):
    """Fields of supplements filled from their papers where blank."""
    p = papers(spark, sf_dir)
    parent = p.select(c("id").alias("parent"), c("journal").alias("j2"), c("doi").alias("d2"))
    rows = p.filter("kind = 'supplement'").join(parent, F.replace("id", F.lit("_supplement"), F.lit("")) == c("parent"))
    return rows.select("id", F.coalesce(text.nz(c("journal")), "j2").alias("journal"), F.coalesce(text.nz(c("doi")), "d2").alias("doi"))


_PREFIX = "lower(regexp_extract(id, '^([A-Z][A-Za-z]+_[0-9]{4})', 1))"


@query(P + f", k AS (SELECT id, {_PREFIX} AS pre, kind FROM p) SELECT a.id AS child, min(b.id) AS parent FROM k a JOIN k b ON a.pre = b.pre AND a.pre <> '' AND a.id <> b.id AND b.kind <> 'supplement' WHERE a.kind = 'supplement' GROUP BY 1")
def jn_08(spark, sf_dir):
    """Parents of supplements by the author-year prefix, real rows only, the first by id."""
    pre = F.lower(F.regexp_extract("id", "^([A-Z][A-Za-z]+_[0-9]{4})", 1))
    k = papers(spark, sf_dir).select("id", pre.alias("pre"), "kind").filter("pre <> ''")
    children = k.filter("kind = 'supplement'").select(c("id").alias("child"), "pre")
    return children.join(k.filter("kind <> 'supplement'").select(c("id").alias("p_id"), "pre"), "pre").filter("child <> p_id").groupBy("child").agg(F.min("p_id").alias("parent"))


@query(P + f", t AS (SELECT id, year, {sql_norm('title')} AS t FROM p WHERE length(title) > 20), a AS (SELECT year, t, min(id) AS id FROM t WHERE t <> '' AND year <> '' GROUP BY 1, 2) SELECT x.id AS id_a, y.id AS id_b FROM a x JOIN a y ON x.year = y.year AND x.t <> y.t AND contains(y.t, x.t)")
def jn_05(spark, sf_dir):
    """Different titles of one year of which one (id_a) stands within the other; each title once, by its first row."""
    t = papers(spark, sf_dir).filter(F.length("title") > 20).select("id", "year", text.norm_sp(c("title")).alias("t")).filter("t <> '' AND year <> ''")
    ensure_checkpoint_dir(spark)
    a = t.groupBy("year", "t").agg(F.min("id").alias("id")).checkpoint()
    found = linkage.contained(a.select(c("id").alias("id_a"), c("t").alias("t_a"), "year"), a.select(c("id").alias("id_b"), c("t").alias("t_b"), "year"), "id_a", "t_a", "id_b", "t_b", same="year").distinct()
    x, y = a.toDF("year_a", "t_a", "id_a"), a.toDF("year_b", "t_b", "id_b")
    return found.join(x, "id_a").join(y, "id_b").filter("year_a = year_b AND t_a <> t_b").select("id_a", "id_b")


@query("WITH o AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000) SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o) AND l_returnflag = 'R' GROUP BY 1")
def jn_23(spark, sf_dir):
    chosen = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(c("o_orderkey").alias("l_orderkey"))
    rest = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").join(chosen, "l_orderkey", "left_anti")
    return rest.groupBy("l_orderkey").agg(F.count("*").alias("n"))


FILES = View("labelled", {"name": "CASE WHEN doc_id % 9 = 0 THEN '.' || source ELSE source || '_' || doc_id END || CASE WHEN quality = 1 THEN '.pdf' WHEN quality = 0 THEN '.docx' WHEN lang = 'en' THEN '.json' ELSE '' END"})
SIDES = View("labels", {"name": "'src' || (doc_id % 20) || '_' || doc_id || CASE WHEN quality = 1 THEN '.pdf' ELSE '.docx' END || '.meta.json'"})


@query(f"WITH {FILES.sql('f')}, {SIDES.sql('s')} SELECT name FROM s WHERE regexp_replace(name, '\\.meta\\.json$', '') NOT IN (SELECT name FROM f)")
def jn_24(spark, sf_dir):
    """Sidecars (of the labels) whose file (a labelled document) is gone or hidden."""
    sides = SIDES.df(spark, sf_dir).withColumn("base", F.regexp_replace("name", r"\.meta\.json$", ""))
    return sides.join(FILES.df(spark, sf_dir).select(c("name").alias("base")), "base", "left_anti").select("name")


@query(f"WITH {FILES.sql('f')}, {SIDES.sql('s')}, a AS (SELECT name FROM f UNION ALL SELECT name FROM s) SELECT name FROM a WHERE NOT starts_with(name, '.') AND NOT regexp_matches(name, '\\.json$')")
def src_07(spark, sf_dir):
    """Which files of a folder are candidates."""
    names = FILES.df(spark, sf_dir).unionByName(SIDES.df(spark, sf_dir))
    return names.filter(~c("name").startswith(".") & ~c("name").rlike(r"\.json$"))


WANTED = View("benchmark", {"item_id": "item_id", "t": "lower(text)"})


@query(P + f", {WANTED.sql('b')}, t AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(title), '[a-z0-9]{{6,}}')) AS w FROM p), s AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(t, '[a-z0-9]{{6,}}')) AS w FROM b) SELECT item_id, id, count(*) AS score FROM t JOIN s ON t.w = s.w GROUP BY 1, 2 HAVING count(*) >= 2")
def jn_25(spark, sf_dir):
    """Rows by the long words that a wanted text (of the benchmark) shares with their titles, two at least."""
    words = lambda x: F.explode(F.array_distinct(F.regexp_extract_all(x, F.lit("[a-z0-9]{6,}"), F.lit(0)))).alias("w")
    wanted = WANTED.df(spark, sf_dir).select("item_id", words(c("t")))
    return papers(spark, sf_dir).select("id", words(F.lower("title"))).join(wanted, "w").groupBy("item_id", "id").agg(F.count("*").alias("score")).filter("score >= 2")


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2 UNION ALL SELECT lang, NULL, count(*), sum(n_chars)::BIGINT FROM documents GROUP BY 1 UNION ALL SELECT NULL, NULL, count(*), sum(n_chars)::BIGINT FROM documents")
def agg_15(spark, sf_dir):
    """The corpus in numbers, with subtotals."""
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT CASE WHEN n_chars < 500 THEN 'too_short' WHEN lang <> 'en' THEN 'other_language' ELSE 'eligible' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def agg_21(spark, sf_dir):
    bucket = F.when(c("n_chars") < 500, "too_short").when(c("lang") != "en", "other_language").otherwise("eligible")
    return table(spark, sf_dir, "documents").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(P + "SELECT array_to_string(list_filter([CASE WHEN count(*) FILTER (title = '') > 0 THEN 'untitled' END, CASE WHEN count(*) FILTER (chars = 0) > 0 THEN 'no_text' END, CASE WHEN count(*) FILTER (id = '') > 0 THEN 'no_id' END], lambda x: x IS NOT NULL), ',') AS blockers FROM p")
def agg_31(spark, sf_dir):
    any_ = lambda cond, name: F.when(F.count_if(cond) > 0, name)
    found = F.array_compact(F.array(any_(c("title") == "", "untitled"), any_(c("chars") == 0, "no_text"), any_(c("id") == "", "no_id")))
    return papers(spark, sf_dir).agg(F.array_join(found, ",").alias("blockers"))


GROUPS = View("conversations", {"k": "conv_id", "ids": "role || ',' || (turn % 3) || ',' || (conv_id % 5)"})


@query(f"WITH {GROUPS.sql('g')} SELECT DISTINCT array_to_string(list_sort(string_split(ids, ',')), ',') AS ids FROM g")
def set_03(spark, sf_dir):
    """Groups that hold the same ids, once."""
    return GROUPS.df(spark, sf_dir).select(F.array_join(F.array_sort(F.split("ids", ",")), ",").alias("ids")).distinct()


@query("SELECT 'short' AS finding, doc_id FROM documents WHERE n_chars < 200 UNION ALL SELECT 'toxic', doc_id FROM labels WHERE toxic = 1")
def set_06(spark, sf_dir):
    short = table(spark, sf_dir, "documents").filter("n_chars < 200").select(F.lit("short").alias("finding"), "doc_id")
    return short.unionByName(table(spark, sf_dir, "labels").filter("toxic = 1").select(F.lit("toxic").alias("finding"), "doc_id"))


@query("SELECT lang, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 2) AS percent FROM documents GROUP BY 1")
def m_04(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    total = d.agg(F.count("*").alias("total"))
    return d.groupBy("lang").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("lang", "n", F.round(100.0 * c("n") / c("total"), 2).alias("percent"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents), s AS (SELECT * FROM h WHERE doc_id % 10 <> 0 AND sha NOT IN (SELECT sha FROM h WHERE doc_id % 10 = 0))
SELECT doc_id FROM s QUALIFY row_number() OVER (PARTITION BY sha ORDER BY doc_id) = 1""")
def w_01(spark, sf_dir):
    """Preflight: staged documents that neither the owned ones nor an earlier staged one holds."""
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    fresh = dedup.not_owned(h.filter("doc_id % 10 <> 0"), h.filter("doc_id % 10 = 0"), "sha")
    return dedup.survivors(fresh, ["sha"], c("doc_id")).select("doc_id")


@query(P + "SELECT id, coalesce(nullif(title, ''), replace(regexp_replace(renamed, '\\.[a-z]+$', ''), '_', ' ')) AS title, CASE WHEN title <> '' THEN 'row' ELSE 'file_name' END AS tier FROM p")
def e_09(spark, sf_dir):
    """The first tier that gives a title."""
    by_name = F.replace(F.regexp_replace("renamed", r"\.[a-z]+$", ""), F.lit("_"), F.lit(" "))
    return papers(spark, sf_dir).select("id", F.coalesce(text.nz(c("title")), by_name).alias("title"), F.when(c("title") != "", "row").otherwise("file_name").alias("tier"))


@query(P + "SELECT id, regexp_extract(renamed, '^([A-Za-z]+)_([0-9]{4})_(.+)\\.[a-z]+$', 1) AS author, regexp_extract(renamed, '^([A-Za-z]+)_([0-9]{4})_(.+)\\.[a-z]+$', 2) AS year, regexp_extract(renamed, '^([A-Za-z]+)_([0-9]{4})_(.+)\\.[a-z]+$', 3) AS title FROM p")
def e_07(spark, sf_dir):
    part = lambda n: F.regexp_extract("renamed", r"^([A-Za-z]+)_([0-9]{4})_(.+)\.[a-z]+$", n)
    return papers(spark, sf_dir).select("id", part(1).alias("author"), part(2).alias("year"), part(3).alias("title"))


@query("SELECT a.doc_id AS doc_id, count(*) AS others FROM (SELECT doc_id, sha256(text) AS s FROM documents) a JOIN (SELECT doc_id, sha256(text) AS s FROM documents) b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1")
def x_08(spark, sf_dir):
    """How many other documents hold the same text: counted per text, not by pairs."""
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("s"))
    n = h.groupBy("s").agg(F.count("*").alias("n")).filter("n > 1")
    return h.join(n, "s").select("doc_id", (c("n") - 1).alias("others"))


@query("SELECT doc_id, CASE WHEN length(text) > 18000 THEN sha256(substring(text, 1, 12000) || chr(10) || '...' || chr(10) || right(text, 6000)) ELSE sha256(text) END AS sha FROM documents")
def x_35(spark, sf_dir):
    """Excerpts of long texts: 12,000 characters, a mark, the last 6,000."""
    cut = F.concat(F.substring("text", 1, 12000), F.lit("\n...\n"), F.right("text", F.lit(6000)))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.when(F.length("text") > 18000, cut).otherwise(c("text")), 256).alias("sha"))


