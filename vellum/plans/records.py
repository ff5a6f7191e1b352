"""Queries over records: keys, parsing, resolution of duplicates, index upkeep. Each opens its tables and has its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import identity, text
from vellum.plans.common import sql_norm, sql_strip
from vellum.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# -- text keys


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))) AS sha FROM documents")
def s_02(spark, sf_dir):
    """Texts without accents, lower case, letters and digits only; as a digest of the whole."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.plain(F.col("text")), 256).alias("sha"))


@query(r"SELECT doc_id, sha256(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g')) AS sha FROM documents")
def s_03(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.replace(text.plain(F.col("text")), F.lit(" "), F.lit("")), 256).alias("sha"))


@query(r"""WITH r AS (SELECT doc_id, CASE WHEN quality = 1 THEN ' Moderate' ELSE 'JUNK ' END || CASE WHEN toxic = 1 THEN ' - flagged' ELSE '' END AS raw FROM labels),
n AS (SELECT doc_id, regexp_replace(lower(trim(raw)), '[\s-]+', '_', 'g') AS label FROM r)
SELECT doc_id, CASE label WHEN 'moderate' THEN 'adequate' WHEN 'junk' THEN 'flawed' ELSE label END AS label FROM n""")
def s_24(spark, sf_dir):
    """Rating labels in one spelling."""
    quality = F.when(F.col("quality") == 1, " Moderate").otherwise("JUNK ")
    raw = F.concat(quality, F.when(F.col("toxic") == 1, " - flagged").otherwise(""))
    return table(spark, sf_dir, "labels").select("doc_id", identity.rating_label(raw).alias("label"))


_TITLE = "regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)"


@query(rf"SELECT page_id, regexp_replace(lower(trim({_TITLE})), '[\s-]+', '_', 'g') AS key FROM pages")
def s_25(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.section_key(F.expr(_TITLE)).alias("key"))


_ONE_SPACE = r"regexp_replace(text, '\s+', ' ', 'g')"


@query(rf"SELECT conv_id, turn, substring({sql_strip(_ONE_SPACE)}, 1, 260) AS t FROM conversations")
def s_28(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring(text.one_space(F.col("text")), 1, 260).alias("t"))


@query("SELECT event_id, epoch(ts)::BIGINT AS seconds FROM events")
def d_04(spark, sf_dir):
    """ISO times with a Z, written and read back."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("iso"))
    stamp = F.try_to_timestamp(F.regexp_replace("iso", "Z$", "+00:00"))
    return e.select("event_id", F.rint(F.unix_micros(stamp) / 1e6).cast("long").alias("seconds"))


# -- tolerant parsing

_RAW = "CASE event_id % 5 WHEN 0 THEN substring(props, 1, length(props) - 1) WHEN 1 THEN '[1]' WHEN 2 THEN '' ELSE props END"


@query(f"""WITH r AS (SELECT event_id, {_RAW} AS raw FROM events)
SELECT event_id, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN (json_extract(raw, '$.k'))::BIGINT END AS k FROM r""")
def j_01(spark, sf_dir):
    """The field of an object; broken, empty and other values count as an empty object."""
    v = F.try_parse_json(F.expr(_RAW))
    k = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$.k", "bigint"))
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"))


@query(f"""WITH r AS (SELECT event_id, {_RAW} AS raw FROM events)
SELECT event_id, CASE WHEN json_valid(raw) THEN lower(json_type(raw)) END AS kind FROM r""")
def j_03(spark, sf_dir):
    """The kind of any parsable value."""
    kind = F.schema_of_variant(F.try_parse_json(F.expr(_RAW)))
    return table(spark, sf_dir, "events").select("event_id", F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").alias("kind"))


# -- ids

_STEM = """CASE doc_id % 9 WHEN 0 THEN 'orphan_' || doc_id WHEN 1 THEN CAST(doc_id AS {0}) WHEN 2 THEN 'Smith_2009_Rhythm' WHEN 3 THEN 'Miller_2011_Situation' || doc_id
WHEN 4 THEN '1753_' || lpad(CAST(doc_id AS {0}), 5, '0') || '_4_S' || doc_id WHEN 5 THEN 'Mulder_Year_Unknown' WHEN 6 THEN 'BF' || lpad(CAST(doc_id AS {0}), 8, '0')
WHEN 7 THEN '_A' || doc_id ELSE source || '_2004_Heart' END"""


@query(f"SELECT doc_id, starts_with(id, 'orphan_') OR starts_with(id, '1_s2_0_') OR starts_with(id, 'BF') OR contains(id, 'Unknown') OR regexp_matches(id, '^(_|[0-9]{{8,}}_|[0-9]+$)') AS legacy FROM (SELECT doc_id, {_STEM.format('VARCHAR')} AS id FROM documents)")
def flt_31(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", identity.legacy_id(F.expr(_STEM.format("STRING"))).alias("legacy"))


@query(f"""SELECT doc_id, regexp_matches(id, '^1_s2_0_') OR regexp_matches(id, '^BF[0-9]{{6,}}$') OR regexp_matches(id, '^[0-9]{{8,}}_[0-9]{{12,}}') OR regexp_matches(id, 'UOW[0-9]+')
  OR regexp_matches(id, '^orphan_') OR regexp_matches(id, '^s[0-9]{{5}}_[0-9]+') OR regexp_matches(id, '^[0-9]{{4}}_[0-9]{{4}}_') OR regexp_matches(id, '^[0-9]{{4}}_[0-9]{{5}}_[0-9]{{3}}$')
  OR regexp_matches(id, '^[0-9]{{4}}_[0-9]{{4,}}_[A-Za-z0-9_]+_S[0-9]+$') OR id = '_pdf' OR regexp_matches(id, '^_[A-Z]') OR regexp_matches(id, '[A-Za-z]+Unknown$') OR regexp_matches(id, '_Year_Unknown$') AS weird,
  regexp_matches(id, '^[A-Z][a-zA-Z]{{2,30}}_[0-9]{{4}}_[A-Za-z][a-zA-Z]{{2,50}}$') AND NOT regexp_matches(lower(id), '(unknow|situatio|situation|international|handbook|auth|main)[0-9]*$') AS reliable
FROM (SELECT doc_id, {_STEM.format('VARCHAR')} AS id FROM documents)""")
def flt_13(spark, sf_dir):
    """Ids to be renamed, and names that may take their place (FLT-14)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_STEM.format("STRING")).alias("id"))
    return d.select("doc_id", identity.weird_id(F.col("id")).alias("weird"), identity.reliable_id(F.col("id")).alias("reliable"))


# -- joins, counts and folds


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def flt_04(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("""SELECT d.source AS source, count(*) AS n, count(*) FILTER (l.quality IS NOT NULL AND l.toxic IS NOT NULL) AS complete
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def agg_16(spark, sf_dir):
    """Complete records by source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).alias("complete"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'low_quality' END AS reason
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE reason IS NOT NULL GROUP BY 1""")
def agg_19(spark, sf_dir):
    """Why records are not settled."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").withColumn("l", F.lit(1)), "doc_id", "left")
    reason = F.when(F.col("l").isNull(), "unlabelled").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality")
    return d.select(reason.alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT conv_id, sum(length(text))::BIGINT AS chars, count(DISTINCT role) AS sections FROM conversations GROUP BY 1")
def agg_30(spark, sf_dir):
    """Characters of all sections together; the texts of a role are one section, summed before they meet."""
    by_role = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.sum(F.length("text")).alias("n"))
    return by_role.groupBy("conv_id").agg(F.sum("n").alias("chars"), F.count("role").alias("sections"))


@query("""WITH a AS (SELECT user_id, list_distinct(list(event_type)) AS x FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),
b AS (SELECT user_id, list_distinct(list(event_type)) AS y FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT a.user_id AS user_id, len(list_intersect(x, coalesce(y, []))) >= least(2, len(x)) AS corroborated FROM a LEFT JOIN b ON a.user_id = b.user_id""")
def jn_26(spark, sf_dir):
    """Names of one list that another list confirms: two, or all where there are fewer."""
    half = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    both = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.collect_set(F.when(half, F.col("event_type"))).alias("x"), F.collect_set(F.when(~half, F.col("event_type"))).alias("y")
    )  # sets of the few event types
    enough = F.size(F.array_intersect("x", "y")) >= F.least(F.lit(2), F.size("x"))
    return both.filter(F.size("x") > 0).select("user_id", enough.alias("corroborated"))


@query("""WITH w AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id + 10000000 FROM labels)
SELECT w.doc_id AS doc_id, d.doc_id IS NOT NULL AS ok, d.lang AS lang, d.source AS source, d.n_chars AS n_chars FROM w LEFT JOIN documents d ON w.doc_id = d.doc_id""")
def prj_03(spark, sf_dir):
    """Details of the records asked for; ``ok`` is false where there is none."""
    ids = table(spark, sf_dir, "labels").select(F.explode(F.array("doc_id", F.col("doc_id") + 10000000)).alias("doc_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.lit(True).alias("ok"))
    return ids.join(d, "doc_id", "left").select("doc_id", F.coalesce("ok", F.lit(False)).alias("ok"), "lang", "source", "n_chars")


# -- resolution


def _first_of(d: DataFrame, key: str, *fields: str) -> DataFrame:
    """Each row with the fields of the row of the smallest id that shares its key: aggregated before the shuffle, joined back."""
    first = d.groupBy(key).agg(F.min(F.struct("doc_id", *fields)).alias("f"))
    return d.join(first, key)


@query(f"""WITH d AS (SELECT doc_id, n_chars, sha256(text) AS sha, {sql_norm('text')} AS norm FROM documents), h AS (SELECT *, substring(norm, 1, 200) AS head FROM d)
SELECT doc_id, CASE WHEN head = '' OR doc_id = first_value(doc_id) OVER w THEN 'NEW' WHEN sha = first_value(sha) OVER w THEN 'SKIP_DUPLICATE'
  WHEN n_chars > 1.10 * first_value(n_chars) OVER w THEN 'REPLACE_WITH_BETTER' ELSE 'SKIP_RELATED' END AS decision FROM h WINDOW w AS (PARTITION BY head ORDER BY doc_id)""")
def c_25(spark, sf_dir):
    """What becomes of a text that shares its head with an earlier one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("sha"), F.substring(text.norm_sp(F.col("text")), 1, 200).alias("head"))
    f = F.col("f")
    decision = (
        F.when((F.col("head") == "") | (F.col("doc_id") == f["doc_id"]), "NEW").when(F.col("sha") == f["sha"], "SKIP_DUPLICATE")
        .when(F.col("n_chars") > 1.10 * f["n_chars"], "REPLACE_WITH_BETTER").otherwise("SKIP_RELATED")
    )
    return _first_of(d, "head", "sha", "n_chars").select("doc_id", decision.alias("decision"))


@query("""WITH d AS (SELECT doc_id, length(text) AS n, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS nth FROM documents)
SELECT doc_id, CASE WHEN nth > 1 THEN 'DELETE_DUPLICATE' WHEN n < 80 THEN 'DELETE_JUNK' WHEN n >= 500 THEN 'MOVE_TO_STAGING_FOR_PROCESSING' END AS decision FROM d""")
def c_26(spark, sf_dir):
    """The tiers of a review that need no similarity: equal texts, too short ones, long enough ones; the rest is open (null)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), F.sha2("text", 256).alias("sha"))
    decision = F.when(F.col("doc_id") != F.col("f.doc_id"), "DELETE_DUPLICATE").when(F.col("n") < 80, "DELETE_JUNK").when(F.col("n") >= 500, "MOVE_TO_STAGING_FOR_PROCESSING")
    return _first_of(d, "sha").select("doc_id", decision.alias("decision"))


# -- index upkeep


@query("SELECT doc_id FROM documents WHERE length(regexp_replace(text, '\\s+', '', 'g')) > 0")
def t_09(spark, sf_dir):
    """Rows with anything to index."""
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"\S")).select("doc_id")


@query("""SELECT source, count(*) FILTER (l.doc_id IS NULL) AS to_add, count(*) FILTER (l.doc_id IS NOT NULL) AS kept FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE length(regexp_replace(text, '\\s+', '', 'g')) > 0 GROUP BY 1""")
def t_04(spark, sf_dir):
    """An index brought up to date: rows that it lacks are added, those it has (here the labelled ones) stay."""
    rows = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"\S")).select("doc_id", "source")
    had = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("had"))
    return rows.join(had, "doc_id", "left").groupBy("source").agg(F.count_if(F.col("had").isNull()).alias("to_add"), F.count_if("had").alias("kept"))


# -- projections of pages


@query(rf"""SELECT page_id, CASE WHEN {_TITLE} = '' THEN NULL ELSE {_TITLE} END AS title, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, length(html)::BIGINT AS chars,
  substring({sql_strip(_ONE_SPACE.replace('text', 'html'))}, 1, 160) AS snippet FROM pages""")
def prj_02(spark, sf_dir):
    """Pages as records of a structured search."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return p.select(
        "page_id", text.nz(F.expr(_TITLE)).alias("title"), host.alias("host"), F.length("html").cast("long").alias("chars"),
        F.substring(text.one_space(F.col("html")), 1, 160).alias("snippet"),
    )


@query("""SELECT d.doc_id AS doc_id, CASE WHEN l.doc_id IS NULL THEN '' ELSE concat_ws('; ', 'status: labelled', 'source: ' || d.source, 'quality: ' || l.quality, 'toxic: ' || l.toxic) END AS chunk
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def prj_06(spark, sf_dir):
    """Evidence about a row as one line of text; empty where there is none."""
    evidence = table(spark, sf_dir, "labels").withColumn("has", F.lit(True))
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(evidence, "doc_id", "left")
    parts = [F.lit("status: labelled"), *(F.concat(F.lit(f"{k}: "), F.col(k).cast("string")) for k in ("source", "quality", "toxic"))]
    return d.select("doc_id", F.when(F.col("has"), F.concat_ws("; ", *parts)).otherwise("").alias("chunk"))


@query(rf"""SELECT page_id, lower({_TITLE}) AS title, array_to_string(list_sort(list_distinct(regexp_extract_all(lower({_TITLE}), '[a-z0-9]{{3,}}'))), ' ') AS tokens,
  regexp_replace(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '\.[a-z0-9]+$', '') AS stem FROM pages""")
def prj_07(spark, sf_dir):
    """Rows flattened to clues for matching: title, its tokens, file stem."""
    title = F.expr(_TITLE)
    stem = F.regexp_replace(F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1), r"\.[a-z0-9]+$", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.lower(title).alias("title"), F.array_join(text.token_set(title), " ").alias("tokens"), stem.alias("stem")
    )


_DRAFT = f"CASE page_id % 7 WHEN 0 THEN {_TITLE} || '.Indd' WHEN 1 THEN 'x print.indd ' || {_TITLE} WHEN 2 THEN '0167-8760_91 90056' WHEN 3 THEN '  ' || substring({_TITLE}, 1, 7) || ' ' WHEN 4 THEN NULL ELSE {_TITLE} END"


@query(rf"""WITH f AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '%PDF-1.7' || html WHEN 1 THEN substring(html, 1, 499) ELSE html END AS content, {_DRAFT} AS title FROM pages)
SELECT page_id, CASE WHEN octet_length(encode(content)) < 500 THEN 'file_too_small' WHEN NOT starts_with(content, '%PDF') THEN 'invalid_pdf_header' ELSE 'ok' END AS reason,
  coalesce(title <> '' AND NOT (ends_with(lower(title), '.indd') OR ends_with(lower(title), '.pdf') OR contains(lower(title), 'print.indd')) AND NOT regexp_full_match(title, '[0-9_ -]{{4,}}')
    AND length({sql_strip('title')}) >= 8, false) AS usable_title FROM f""")
def x_10(spark, sf_dir):
    """Why a file is no valid PDF (500 bytes at least, the mark at its head), and titles of files that may be used (X-17)."""
    content = F.expr("CASE page_id % 3 WHEN 0 THEN concat('%PDF-1.7', html) WHEN 1 THEN substring(html, 1, 499) ELSE html END")
    reason = F.when(F.octet_length(content) < 500, "file_too_small").when(~content.startswith("%PDF"), "invalid_pdf_header").otherwise("ok")
    return table(spark, sf_dir, "pages").select("page_id", reason.alias("reason"), identity.usable_title(F.expr(_DRAFT)).alias("usable_title"))


@query(f"""SELECT page_id, title, score FROM (SELECT page_id, {_TITLE} AS title, (length({_TITLE}) BETWEEN 12 AND 180)::INTEGER * 2 + regexp_matches({_TITLE}, '^[A-Z]')::INTEGER
  + (len(string_split({_TITLE}, ' ')) >= 3)::INTEGER AS score FROM pages) ORDER BY score DESC, title, page_id LIMIT 20""")
def top_08(spark, sf_dir):
    """The twenty best candidates for a title, by a score of length, capital and words."""
    title = F.expr(_TITLE)
    score = F.length(title).between(12, 180).cast("int") * 2 + title.rlike("^[A-Z]").cast("int") + (F.size(F.split(title, " ")) >= 3).cast("int")
    p = table(spark, sf_dir, "pages").select("page_id", title.alias("title"), score.alias("score"))
    return p.orderBy(F.desc("score"), "title", "page_id").limit(20)
