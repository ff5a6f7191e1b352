"""Queries on sections, JSON trees, the chunk store and recovery from logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import sections, trees
from vellum.operators import chunk_store, recovery, store
from vellum.plans.common import View, pick, sql_strip, word
from vellum.sources.tables import table

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


# -- sections: the documents' own lines under headings, as no document has any

_HEADS = ["Abstract", "Introduction", "Materials and Methods", "Results", "Discussion", "Conclusions", "References", "Appendix"]
HEADED = View(
    "documents",
    {
        "doc_id": "doc_id",
        "t": "substring(text, 1, 40) || " + " || ".join(f"chr(10) || {pick(f'(doc_id + {k})', _HEADS)} || chr(10) || substring(text, {1 + 300 * k}, {90 + 300 * k})" for k in range(3)) + f" || CASE WHEN doc_id % 2 = 0 THEN '. ' || {pick('doc_id', _HEADS)} || ' follow' ELSE '' END",
    },
)
_HEADING = "(materials?\\s+and\\s+methods?|abstract|introduction|methods?|results?|discussion|conclusions?|acknowledge?ments?|references|appendix|supplementary)"
_CANON = """CASE WHEN starts_with(h, 'mat') OR starts_with(h, 'method') THEN 'methods' WHEN starts_with(h, 'result') THEN 'results' WHEN starts_with(h, 'conclusion') THEN 'conclusion'
  WHEN starts_with(h, 'acknowledg') THEN 'acknowledgements' ELSE h END"""


@query(rf"""WITH {HEADED.sql('d')}, m AS (SELECT doc_id, string_split(regexp_replace(t, '(?i)(^|[\n\r]|[.][ \n]){_HEADING}\b', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM d),
e AS (SELECT doc_id, i, p[i] AS x, array_to_string(p[i:], '') AS rest FROM m, unnest(range(2, len(p) + 1)) AS r(i)),
h AS (SELECT doc_id, i, lower(regexp_extract(x, '(?i)^{_HEADING}\b', 1)) AS h, CASE WHEN contains(x, chr(10)) THEN substring(x, strpos(x, chr(10))) WHEN contains(rest, chr(10)) THEN '' ELSE x END AS body FROM e),
s AS (SELECT doc_id, i, {_CANON} AS name, {sql_strip('body')} AS body FROM h)
SELECT doc_id, name, sha256(body) AS sha FROM s WHERE body <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY i DESC) = 1""")
def c_14_sections(spark, sf_dir):
    """Sections by their headings, the last of a name (C-14, WIN-09)."""
    found = HEADED.df(spark, sf_dir).select("doc_id", F.explode(sections.parse(c("t"))).alias("s"))
    return found.select("doc_id", "s.name", F.sha2("s.body", 256).alias("sha"))


# -- JSON

NESTED = View(
    "events",
    {
        "id": "event_id",
        "j": "'{\"file_info\": {\"path\": \"a/' || event_id || '.pdf\", \"sizes\": [1, \"x/' || user_id || '\", {\"renamed\": \"r' || event_id || '.PDF\", \"reason\": \"a/b\"}]}, "
        "\"note\": \"c/d\", \"source_pdf_reconciliation\": {\"path\": \"z/' || user_id || '\"}, \"sha\": \"' || SHA<event_type>SHA || '\", \"props\": ' || props || '}'",
    },
)


@query(f"""WITH {NESTED.sql('e')}, w AS (SELECT e.id, substring(fullkey, 3) AS path, json_extract_string(atom, '$') AS leaf FROM e, json_tree(j) AS jt WHERE jt.type = 'VARCHAR')
SELECT id, path, leaf FROM w WHERE regexp_matches(path, '(?i)(file|path|pdf|filename|renamed|source|supplement|sha|hash)') AND NOT contains(path, 'source_pdf_reconciliation')
  AND list_last(string_split(path, '.')) NOT IN ('reason', 'basename', 'source_pdf_reconciled_at') AND (contains(lower(leaf), '.pdf') OR contains(leaf, '/') OR contains(leaf, '\\') OR regexp_matches(trim(lower(leaf)), '^[a-f0-9]{{32,128}}$'))""")
def prj_11(spark, sf_dir):
    """What names files within nested JSON, by its path."""
    found = trees.file_references(trees.leaves(NESTED.df(spark, sf_dir), "id", "j"))
    return found.select("id", "path", "leaf")


_SHAPES = [
    '["{l}", "{s}"]', '["{l}", ["{s}", "more"]]', '["[{b}"{l}{b}", {b}"{s}{b}"]", "z"]', '["odd {l},[{s}"]', "{l}", '{{"{l}": 1}}', "[]", '["{l}, {s}"]', "",
]
_SHAPE = "(CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN " + ("'" + s.replace("{{", "{").replace("}}", "}").replace("{l}", "' || lang || '").replace("{s}", "' || source || '").replace("{b}", "' || chr(92) || '") + "'") for k, s in enumerate(_SHAPES)) + " END)"
TAGGED = View("documents", {"doc_id": "doc_id", "k": "doc_id % 9", "v": _SHAPE, "lang": "lang", "source": "source"})


@query(f"""WITH {TAGGED.sql('t')} SELECT doc_id, CASE k WHEN 0 THEN lang || '|' || source WHEN 1 THEN lang || '|' || source || '|more' WHEN 2 THEN lang || '|' || source || '|z' WHEN 3 THEN 'odd ' || lang || '|[' || source
  WHEN 4 THEN lang WHEN 5 THEN v WHEN 7 THEN lang || ', ' || source ELSE '' END AS tags FROM t""")
def j_04(spark, sf_dir):
    """Tag lists of whatever shape: nested, JSON within strings, by commas."""
    return TAGGED.df(spark, sf_dir).select("doc_id", F.array_join(trees.tags(c("v")), "|").alias("tags"))


YEARS = View(
    "documents",
    {"doc_id": "doc_id", "t": f"{word(1)} || ' Published ' || (1950 + n_chars % 70) || '. ' || substring(text, 1, 300) || ' in ' || (1980 + doc_id % 30) || ', then ' || (1950 + n_chars % 70) || ' ' || substring(text, 301, 200) || ' and ' || (1980 + doc_id % 7)"},
)


@query()
def top_09(spark, sf_dir):
    """The years of a text by what stands near them (``tests/test_upkeep.py`` holds the expression against a loop)."""
    return YEARS.df(spark, sf_dir).select("doc_id", F.array_join(trees.years(c("t")), ",").alias("years"))


# -- the chunk store

_CHUNKED = f"""t AS (SELECT doc_id, {sql_strip('text')} AS s FROM now),
k AS (SELECT doc_id, s, unnest(range(0, CASE WHEN length(s) <= 1400 THEN 1 ELSE ceil((length(s) - 1400) / 1220.0)::INTEGER + 1 END)) AS i FROM t WHERE length(s) >= 80),
x AS (SELECT doc_id, i, {sql_strip('substring(s, (i * 1220 + 1)::BIGINT, 1400)')} AS x FROM k)"""
_NOW = "now AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'again ' || text ELSE text END AS text FROM documents WHERE source <> 'src1')"


def _updated(spark, sf_dir):
    """A store of the English documents, then of all but one source, the toxic ones rewritten."""
    held = chunk_store.ChunkStore(spark, store.folder(spark, "chunks"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    held.update(d.filter("lang = 'en'"))
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("toxic"))
    now = d.filter("source <> 'src1'").join(toxic, "doc_id", "left").withColumn("text", F.when(c("toxic"), F.concat(F.lit("again "), "text")).otherwise(c("text")))
    return held, held.update(now)


@query(f"WITH {_NOW}, {_CHUNKED} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk, sha256(x) AS sha FROM x WHERE length(x) >= 80")
def t_04_store(spark, sf_dir):
    """What a chunk store holds after an update: new, changed and missing documents (T-04, SNK-15)."""
    held, _ = _updated(spark, sf_dir)
    return held.chunks().select("doc_id", "chunk", F.sha2("chunk_text", 256).alias("sha"))


@query(f"""WITH {_NOW}, had AS (SELECT doc_id, text FROM documents WHERE lang = 'en'),
b AS (SELECT n.doc_id AS a, h.doc_id AS b, n.text AS x, h.text AS y FROM now n FULL JOIN had h ON n.doc_id = h.doc_id)
SELECT count(*) FILTER (a IS NOT NULL AND (b IS NULL OR x <> y)) AS put, count(*) FILTER (a IS NULL) AS gone FROM b""")
def t_04_manifest(spark, sf_dir):
    """What the second commit of that store says of itself."""
    held, _ = _updated(spark, sf_dir)
    return spark.read.schema("put long, gone long, v int").json(f"{held.path}/manifest").filter("v = 1").select("put", "gone")


@query(f"""WITH {_NOW}, {_CHUNKED}, n AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk, lower(x) AS x FROM x WHERE length(x) >= 80),
s AS (SELECT doc_id, chunk, (contains(x, 'hand')::INTEGER + contains(x, 'tionwh')::INTEGER + contains(x, 'einsch')::INTEGER) AS score FROM n),
b AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk) = 1) SELECT doc_id, score, chunk FROM b ORDER BY score DESC, doc_id LIMIT 25""")
def t_04_search(spark, sf_dir):
    """The best chunk of the 25 best documents of the store for three words."""
    held, _ = _updated(spark, sf_dir)
    return held.search(["hand", "tionwh", "einsch"], 25)


# -- recovery

LOG = View("events", {"id": "user_id", "nr": "event_id", "kind": "CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END", "sha": "CASE WHEN value > 1 THEN props END"})
_PAST = "u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY nr DESC) AS n FROM e WHERE nr <= {at}), p AS (SELECT id, arg_max(coalesce(sha, '-'), nr) AS sha FROM u WHERE kind = 'put' GROUP BY 1), l AS (SELECT u.id, u.kind, nullif(p.sha, '-') AS sha FROM u JOIN p ON u.id = p.id WHERE n = 1)"


def _log(spark, sf_dir):
    return LOG.df(spark, sf_dir).withColumnRenamed("nr", "at")


@query(f"WITH {LOG.sql('e')}, {_PAST.format(at=500)} SELECT id, sha FROM l WHERE kind = 'put'")
def w_28(spark, sf_dir):
    """What a log's table held at a moment."""
    return recovery.state_at(_log(spark, sf_dir), 500)


@query(f"WITH {LOG.sql('e')}, {_PAST.format(at=10**12)} SELECT id, sha, CASE WHEN sha IS NULL THEN 'unknown_content' WHEN sha IN (SELECT sha FROM l WHERE kind = 'put' AND sha IS NOT NULL) THEN 'confirmed_duplicate' ELSE 'restore' END AS verdict FROM l WHERE kind = 'delete'")
def w_28_deletions(spark, sf_dir):
    """Which deletions of a log took content that no other row holds."""
    return recovery.deletions(_log(spark, sf_dir), 10**12)
