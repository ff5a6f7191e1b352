"""Queries over documents, pages and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import gates, text
from vellum.operators import dedup, linkage, retrieval, store
from vellum.plans.common import View, pick, sql_norm, sql_strip, sql_tokens
from vellum.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))


@query("SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 10 <> 0 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)")
def jn_01(spark, sf_dir):
    """Staged documents that the owned ones (ids divisible by ten) hold already."""
    d = hashed(spark, sf_dir).select("doc_id", "sha")
    return dedup.already_owned(d.filter("doc_id % 10 <> 0"), d.filter("doc_id % 10 = 0"), "sha").select("doc_id", "sha")


@query("SELECT doc_id, sha256(text) AS sha FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def jn_02(spark, sf_dir):
    return dedup.survivors(hashed(spark, sf_dir).select("doc_id", "sha"), ["sha"], F.col("doc_id")).select("doc_id", "sha")


@query("SELECT a.doc_id, a.n_chars FROM documents a WHERE a.doc_id % 10 <> 0 AND EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 10 = 0 AND b.n_chars = a.n_chars AND sha256(b.text) = sha256(a.text))")
def jn_03(spark, sf_dir):
    """As jn_01, blocked by size first."""
    d = hashed(spark, sf_dir).select("doc_id", "n_chars", "sha")
    return d.filter("doc_id % 10 <> 0").join(d.filter("doc_id % 10 = 0").select("n_chars", "sha").distinct(), ["n_chars", "sha"], "left_semi").select("doc_id", "n_chars")


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def agg_09(spark, sf_dir):
    return dedup.groups(hashed(spark, sf_dir), "sha", "doc_id")


_KEPT = """
WITH h AS (SELECT d.doc_id, sha256(text) AS sha, count(l.doc_id) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2),
k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY sha ORDER BY n DESC, doc_id) = 1)
"""


def _kept(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = hashed(spark, sf_dir).select("doc_id", "sha").join(labels, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows, dedup.survivors(rows, ["sha"], -F.col("n"), F.col("doc_id"))


@query(_KEPT + "SELECT doc_id, sha, n AS n_labels FROM k")
def top_05(spark, sf_dir):
    """Of each group of copies the row with most labels, then the smallest id."""
    return _kept(spark, sf_dir)[1].select("doc_id", "sha", F.col("n").alias("n_labels"))


@query(_KEPT + "SELECT k.doc_id AS kept_id, count(*) AS n, sum(l.toxic)::BIGINT AS toxic FROM labels l JOIN h ON l.doc_id = h.doc_id JOIN k ON h.sha = k.sha GROUP BY 1")
def w_07(spark, sf_dir):
    """Labels redirected to the kept copy, counted anew."""
    rows, kept = _kept(spark, sf_dir)
    moved = dedup.redirected(table(spark, sf_dir, "labels"), rows, kept, "sha", "doc_id")
    return moved.groupBy("kept_id").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))


@query("SELECT sha256(text) AS sha, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def win_06(spark, sf_dir):
    return dedup.latest(hashed(spark, sf_dir), ["sha"], ["doc_id"], "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn_22(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def set_04(spark, sf_dir):
    return jn_22_rows(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))


def jn_22_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


# Files as their documents make them: what the ladder asks of each, by its length, language and source.
EXTRACTED = View(
    "documents",
    {
        "doc_id": "doc_id", "found": "source <> 'src0'", "is_pdf": "lang <> 'es'", "header_ok": "source <> 'src1'", "tool": "CASE source WHEN 'src2' THEN 'not_found' WHEN 'src3' THEN 'crashed' ELSE 'ok' END",
        "preview": "n_chars - 300", "native": "CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE n_chars % 150 END", "second": "n_chars % 400", "ocr": "CASE WHEN doc_id % 4 = 1 THEN n_chars % 25 END",
        "ocr_state": pick("n_chars", ["not_asked", "unavailable", "failed", "ran", "ran"]), "pages": "n_chars % 3", "size": "n_chars",
    },
)


@query(f"""WITH {EXTRACTED.sql('e')}, b AS (SELECT *, coalesce(ocr, 0) AS o, CASE WHEN second > native THEN ':second' ELSE ':native' END AS best FROM e)
SELECT doc_id, CASE WHEN NOT found THEN 'WRONG_PATH_OR_MISSING_FILE:none' WHEN NOT is_pdf THEN CASE WHEN preview >= 20 THEN 'TEXT_OK:preview' ELSE 'TRUE_EMPTY_TEXT:preview' END WHEN NOT header_ok THEN 'CORRUPT_OR_UNREADABLE:none'
  WHEN tool = 'not_found' THEN 'EXTRACTOR_UNAVAILABLE:none' WHEN tool = 'crashed' THEN 'EXTRACTOR_CRASHED:none' WHEN native >= 200 THEN 'TEXT_OK:native' WHEN second >= 200 THEN 'TEXT_OK:second'
  WHEN ocr_state = 'not_asked' THEN CASE WHEN pages >= 1 THEN 'OCR_REQUIRED' ELSE 'TRUE_EMPTY_TEXT' END || best WHEN ocr_state = 'unavailable' THEN 'EXTRACTOR_UNAVAILABLE' || best WHEN o >= 20 THEN 'TEXT_OK:ocr'
  WHEN ocr_state = 'failed' THEN 'OCR_FAILED' || best WHEN pages >= 1 AND size >= 500 THEN 'TRUE_EMPTY_TEXT' || best ELSE 'CORRUPT_OR_UNREADABLE' || best END AS status FROM b""")
def c_12(spark, sf_dir):
    """The ladder of extractors: eight states, and the source of the text."""
    e = EXTRACTED.df(spark, sf_dir)
    file = {k: F.col(k) for k in e.columns if k not in ("doc_id", "found")} | {"exists": F.col("found")}
    return e.select("doc_id", gates.extraction(file).alias("status"))


@query("SELECT doc_id, lang, n_chars, CASE WHEN n_chars BETWEEN 5000 AND 150000 THEN 0 WHEN n_chars < 5000 THEN 1 ELSE 2 END AS bucket FROM documents ORDER BY bucket, lang, n_chars DESC, doc_id LIMIT 200")
def top_04(spark, sf_dir):
    """The first 200 of the evaluation queue."""
    bucket = F.when(F.col("n_chars").between(5000, 150000), 0).when(F.col("n_chars") < 5000, 1).otherwise(2)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", bucket.alias("bucket")).orderBy("bucket", "lang", F.desc("n_chars"), "doc_id").limit(200)


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INTEGER AS rn FROM documents) SELECT * FROM r ORDER BY rn, lang LIMIT 40")
def win_08(spark, sf_dir):
    return dedup.round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 40, F.col("doc_id"))


def _windows_sql(size: int, overlap: int, least: int) -> str:
    step = size - overlap
    return f"""
WITH t AS (SELECT doc_id, {sql_strip('text')} AS s FROM documents),
k AS (SELECT doc_id, s, unnest(range(0, CASE WHEN length(s) <= {size} THEN 1 ELSE ceil((length(s) - {size}) / {step}.0)::INTEGER + 1 END)) AS i FROM t WHERE length(s) >= {least}),
c AS (SELECT doc_id, i, {sql_strip(f"substring(s, (i * {step} + 1)::BIGINT, {size})")} AS x FROM k)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk, length(x)::INTEGER AS chars, sha256(x) AS sha FROM c WHERE length(x) >= {least}"""


def _chunk_rows(spark, sf_dir, size, overlap, least):
    found = retrieval.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", size, overlap, least)
    return found.select("doc_id", "chunk", F.length("chunk_text").alias("chars"), F.sha2("chunk_text", 256).alias("sha"))


@query(_windows_sql(1400, 180, 80))
def t_01(spark, sf_dir):
    return _chunk_rows(spark, sf_dir, 1400, 180, 80)


@query(_windows_sql(1600, 200, 120))
def t_02(spark, sf_dir):
    return _chunk_rows(spark, sf_dir, 1600, 200, 120)


@query("SELECT doc_id, greatest(1, ceil(greatest(0, n_chars - 180) / 1220.0))::BIGINT AS estimate FROM documents")
def m_03(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.chunk_estimate(F.col("n_chars"), 1400, 180).cast("long").alias("estimate"))


@query("SELECT lang, sum(greatest(1, ceil(greatest(0, n_chars - 250) / 1550.0)))::BIGINT AS chunks, count(*) AS n FROM documents GROUP BY 1")
def t_12(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.sum(retrieval.chunk_estimate(F.col("n_chars"), 1800, 250)).cast("long").alias("chunks"), F.count("*").alias("n"))


@query(f"SELECT doc_id, CASE WHEN length(trim(substring(text, 1, 200))) > 60 THEN 1 ELSE 0 END::INTEGER AS has_abstract, length(trim(substring(text, 1, 200)))::INTEGER AS chars FROM documents WHERE length({sql_strip('text')}) > 0")
def t_03(spark, sf_dir):
    head = F.trim(F.substring("text", 1, 200))
    d = table(spark, sf_dir, "documents").filter(F.length(text.strip(F.col("text"))) > 0)
    return d.select("doc_id", F.when(F.length(head) > 60, 1).otherwise(0).alias("has_abstract"), F.length(head).alias("chars"))


@query(f"SELECT doc_id, {sql_norm('text')} AS norm FROM documents")
def s_01(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.norm_sp(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, replace({sql_norm('text')}, ' ', '') AS compact FROM documents")
def s_05(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.compact(F.col("text")).alias("compact"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents")
def s_06(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.one_space(F.col("text")).alias("t"))


@query(f"SELECT doc_id, substring(sha256({sql_norm('text')}), 1, 20) AS fp FROM documents")
def s_39(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fp"))


@query(f"SELECT substring({sql_norm('text')}, 1, 200) AS head, count(*) AS n, count(DISTINCT sha256(text)) AS texts FROM documents GROUP BY 1 HAVING count(*) > 1")
def s_39_heads(spark, sf_dir):
    """Documents that agree in their first 200 normalised characters."""
    d = hashed(spark, sf_dir).select(F.substring(text.norm_sp(F.col("text")), 1, 200).alias("head"), "sha")
    return d.groupBy("head").agg(F.count("*").alias("n"), F.countDistinct("sha").alias("texts")).filter("n > 1")


@query("SELECT doc_id, sha256(text) AS sha, substring(sha256(text), 1, 8) AS token FROM documents")
def s_43(spark, sf_dir):
    return hashed(spark, sf_dir).select("doc_id", "sha", F.substring("sha", 1, 8).alias("token"))


@query(f"SELECT doc_id, array_to_string({sql_tokens('text')}, ' ') AS tokens FROM documents")
def s_10(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.token_set(F.col("text")), " ").alias("tokens"))


@query(f"""WITH t AS (SELECT doc_id, {sql_tokens('text')} AS k FROM documents)
SELECT a.doc_id, len(list_intersect(a.k, b.k))::INTEGER AS shared FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def set_02(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", text.token_set(F.col("text")).alias("k"))
    b = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("k").alias("k2"))
    return t.join(b, "doc_id").select("doc_id", F.size(F.array_intersect("k", "k2")).alias("shared"))


@query("""SELECT doc_id, sha256(CASE WHEN length(text) > 2000 THEN substring(substring(text, 1, 900) || chr(10) || '[...]' || chr(10) || substring(text, length(text) // 2 - 200 + 1, 400)
  || chr(10) || '[...]' || chr(10) || right(text, 700), 1, 2000) ELSE text END) AS sha FROM documents""")
def s_26(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.head_mid_tail(F.col("text"), 2000, 400), 256).alias("sha"))


@query(f"""SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[1:25], lambda x: {sql_strip('x')}),
  lambda x: length(x) BETWEEN 20 AND 220 AND regexp_matches(x, '^[A-Z]'))[1] AS title FROM documents""")
def e_06(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_line(F.col("text"), 20, 220, 25).alias("title"))


@query(f"""SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[1:30], lambda x: {sql_strip('x')}),
  lambda x: length(x) BETWEEN 12 AND 180 AND regexp_matches(x, '^[A-Z]'))[1] AS title FROM documents""")
def x_18(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_line(F.col("text"), 12, 180, 30).alias("title"))


@query(f"""SELECT doc_id, len(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}),
  lambda x: length(x) > 4 AND length(x) <= 90 AND regexp_matches(x, '^[A-Z][A-Z0-9 .,!-]*$'))))::INTEGER AS n FROM documents""")
def s_38(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.headings(F.col("text"), 1 << 30)).alias("n"))


@query("""WITH u AS (SELECT 'page' AS kind, page_id AS id, html AS t FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)
SELECT kind, id, CASE WHEN length(t) = 0 THEN 'empty' WHEN starts_with(t, '%PDF') THEN 'pdf'
  WHEN starts_with(ltrim(substring(t, 1, 200), ' ' || chr(9) || chr(10) || chr(13)), '<!') OR contains(lower(substring(t, 1, 200)), '<html') THEN 'html'
  WHEN contains(substring(t, 1, 400), 'Content-Type:') THEN 'mime'
  WHEN contains(substring(t, 1, 200), ',') AND contains(substring(t, 1, 400), chr(10)) THEN 'csv'
  WHEN regexp_matches(t, '^\\s*[{\\[]') THEN 'text_structured' ELSE 'text' END AS content FROM u""".replace("\\\\", "\\"))
def c_01(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("t"))
    d = table(spark, sf_dir, "documents").select(F.lit("document"), "doc_id", "text").toDF("kind", "id", "t")
    return p.unionByName(d).select("kind", "id", gates.sniffed(F.col("t")).alias("content"))


@query("""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
  regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page FROM pages""")
def s_33_urls(spark, sf_dir):
    part = lambda p, n: F.regexp_extract("url", p, 1).alias(n)
    return table(spark, sf_dir, "pages").select("page_id", part("^(https?)://", "scheme"), part("^https?://([^/?#]+)", "host"), part("[?&]page=([^&#]*)", "page"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def jn_13(spark, sf_dir):
    """Documents that hold a benchmark passage whole."""
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "item_text")
    return linkage.contained(items, table(spark, sf_dir, "documents"), "item_id", "item_text", "doc_id", "text")


_TITLES = "(SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) AS title FROM pages)"


@query(f"""WITH p AS (SELECT page_id, unnest({sql_tokens('title')}) AS t FROM {_TITLES}),
s AS (SELECT a.page_id AS l_id, b.page_id AS r_id, count(*) AS shared FROM p a JOIN p b ON a.t = b.t AND a.page_id <> b.page_id GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY r_id) = 1""")
def jn_18(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title[^>]*>([^<]*)</title>", 1).alias("title"))
    return linkage.shared_tokens(p, p, "page_id", "page_id", "title", "title")


@query("""WITH p AS (SELECT url, lead(url) OVER (ORDER BY url, page_id) AS nxt, page_id FROM pages WHERE url IS NOT NULL)
SELECT page_id, list_max(list_filter(range(0, least(length(url), length(nxt)) + 1), lambda k: substring(url, 1, k) = substring(nxt, 1, k)))::INTEGER AS common
FROM p WHERE nxt IS NOT NULL""")
def win_04(spark, sf_dir):
    """Each url's common prefix with the next in order."""
    from vellum.sources.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    p = linkage.following(table(spark, sf_dir, "pages").filter("url IS NOT NULL").select("url", "page_id"), ["url", "page_id"])
    return p.filter("next IS NOT NULL").select("page_id", text.common_prefix(F.col("url"), F.col("next.url")).alias("common"))


@query("""WITH bad AS (SELECT doc_id FROM labels WHERE toxic = 1), new AS (SELECT doc_id, 'xx' AS lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM bad)
  UNION ALL SELECT doc_id + 100000000, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM bad))
SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new""")
def snk_01(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    touched = d.join(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    changed = touched.withColumn("lang", F.lit("xx"))
    added = touched.withColumn("doc_id", F.col("doc_id") + 100000000)
    return store.upsert(d, changed.unionByName(added), "doc_id")


@query("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'flagged' ELSE d.source END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def snk_03(spark, sf_dir):
    changes = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit("flagged").alias("source"))
    return store.patch(table(spark, sf_dir, "documents").select("doc_id", "source"), changes, "doc_id", ["source"])


@query("SELECT doc_id, lang, NOT coalesce(l.toxic = 1, false) AS stays FROM (SELECT doc_id, lang FROM documents) d LEFT JOIN labels l USING (doc_id)")
def snk_04(spark, sf_dir):
    """Rows are exported before they are deleted, and counted; the export is read back."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    stay, gone = store.delete_exported(d, table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", store.folder(spark, "deleted"))
    return stay.withColumn("stays", F.lit(True)).unionByName(gone.withColumn("stays", F.lit(False)))


@query("""WITH r AS (SELECT sha256(coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(length(lang) || ':' || lang, '-') || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-')
  || coalesce(length(source) || ':' || source, '-') || coalesce(length(text) || ':' || text, '-')) AS h FROM documents)
SELECT 'documents' AS name, count(*) AS n, sum(('0x' || substring(h, 1, 15))::BIGINT)::VARCHAR AS digest FROM r""")
def agg_28(spark, sf_dir):
    return store.digest(table(spark, sf_dir, "documents"), "doc_id").select(F.lit("documents").alias("name"), "n", "digest")


@query("SELECT doc_id FROM documents WHERE false")
def w_23_empty_scope(spark, sf_dir):
    """A rollback of no ids takes nothing back."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return store.delete(d, d.limit(0), "doc_id")[1]


def set_05(spark, sf_dir):
    """Groups by same text, same first or same last 200 normalised characters."""
    from vellum.sources.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    norm = text.norm_sp(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("a"), F.substring(norm, 1, 200).alias("b"), F.right(norm, F.lit(200)).alias("c"))
    d = d.checkpoint()  # texts are brought to their normal form once, not for each key
    pairs = None
    for k in "abc":
        told = d.filter(F.col(k) != "").select("doc_id", k)  # a blank key says nothing
        found = told.join(told.groupBy(k).agg(F.min("doc_id").alias("first_id")), k).select("doc_id", "first_id")
        pairs = found if pairs is None else pairs.unionByName(found)
    groups = dedup.connected(pairs, "doc_id", "first_id")
    return groups.select(F.col("node").alias("doc_id"), F.col("label").alias("group_id"))


_CC = """
WITH RECURSIVE d AS (SELECT doc_id, sha256(text) AS a, substring({0}, 1, 200) AS b, right({0}, 200) AS c FROM documents),
e AS (SELECT x.doc_id AS u, y.doc_id AS v FROM d x JOIN d y ON x.a = y.a OR (x.b = y.b AND x.b <> '') OR (x.c = y.c AND x.c <> '')),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT u AS doc_id, min(v) AS group_id FROM r GROUP BY 1""".format(sql_norm("text"))
QUERIES["set_05"], ORACLE["set_05"] = set_05, _CC


def s_32(spark, sf_dir):
    """Fuzzy ratio of the titles of neighbouring pages."""
    t = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title[^>]*>([^<]*)</title>", 1).alias("h"))
    b = t.select((F.col("page_id") - 1).alias("page_id"), F.col("h").alias("h2"))
    return t.join(b, "page_id").select("page_id", linkage.seq_ratio("h", "h2").alias("ratio"))


QUERIES["s_32"] = s_32
