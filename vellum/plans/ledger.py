"""Queries over events, conversations, labels and vectors: ledgers, costs, ratings, vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import ratings
from vellum.operators import dedup, retrieval
from vellum.plans.common import NOW, pick, View
from vellum.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT user_id, event_type AS last_type, event_id AS last_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def win_01(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnsRenamed({"event_type": "last_type"}).withColumn("last_id", F.col("event_id"))
    return dedup.latest(e, ["user_id"], ["last_type", "last_id"], "ts", "event_id")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'")
def win_02(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("saved")).filter("saved").select("user_id")


@query(f"""WITH a AS (SELECT user_id, date_diff('day', min(ts)::DATE, TIMESTAMP '{NOW}'::DATE) AS age FROM events GROUP BY 1)
SELECT count(*) AS n, max(age)::INTEGER AS oldest, count(*) FILTER (age >= 31) AS old FROM a""")
def agg_20(spark, sf_dir):
    age = F.datediff(F.lit(NOW).cast("timestamp"), F.min("ts")).alias("age")
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(age)
    return a.agg(F.count("*").alias("n"), F.max("age").alias("oldest"), F.count_if(F.col("age") >= 31).alias("old"))


@query(f"SELECT user_id, greatest(0, floor((epoch(TIMESTAMP '{NOW}') - epoch(min(ts))) / 86400))::BIGINT AS days FROM events GROUP BY 1")
def d_01(spark, sf_dir):
    micros = F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.greatest(F.lit(0), F.floor(micros / 86_400_000_000)).cast("long").alias("days"))


@query("SELECT json_extract_string(props, '$.k')::INTEGER AS k, count(*) AS n FROM events GROUP BY 1")
def j_02(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT event_type AS tag FROM events UNION ALL SELECT 'k' || json_extract_string(props, '$.k') FROM events)
SELECT tag, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, tag LIMIT 20""")
def agg_12(spark, sf_dir):
    tags = F.explode(F.array("event_type", F.concat(F.lit("k"), F.get_json_object("props", "$.k")))).alias("tag")
    return table(spark, sf_dir, "events").select(tags).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(20)


@query("SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def agg_17(spark, sf_dir):
    """Counters by kind and day."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("""WITH l AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT count(*) AS keys, count(*) FILTER (event_type = 'purchase') AS saved, count(*) FILTER (event_type <> 'purchase') AS open,
  CASE WHEN count(*) FILTER (event_type <> 'purchase') = 0 THEN 'COMPLETE' ELSE 'COMPLETE_WITH_OPEN' END AS status FROM l""")
def agg_18(spark, sf_dir):
    """Outcomes by the last event of each key, and the run's status."""
    last = dedup.latest(table(spark, sf_dir, "events"), ["user_id"], ["event_type"], "ts", "event_id")
    opened = F.count_if(F.col("event_type") != "purchase")
    return last.agg(
        F.count("*").alias("keys"), F.count_if(F.col("event_type") == "purchase").alias("saved"), opened.alias("open"),
        F.when(opened == 0, "COMPLETE").otherwise("COMPLETE_WITH_OPEN").alias("status"),
    )


@query("""WITH t AS (SELECT conv_id, role, floor(length(text) / 3.5) AS tokens FROM conversations)
SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN 0 ELSE tokens END)::BIGINT AS tokens_in, sum(CASE WHEN role = 'assistant' THEN tokens ELSE 0 END)::BIGINT AS tokens_out,
  sum(CASE WHEN role = 'assistant' THEN tokens * 15 ELSE tokens * 3 END) / 1e6 AS cost FROM t GROUP BY 1""")
def agg_22(spark, sf_dir):
    tokens, out = F.floor(F.length("text") / 3.5), F.col("role") == "assistant"
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.sum(F.when(out, 0).otherwise(tokens)).alias("tokens_in"), F.sum(F.when(out, tokens).otherwise(0)).alias("tokens_out"),
        (F.sum(F.when(out, tokens * 15).otherwise(tokens * 3)) / 1e6).alias("cost"),
    )


@query("SELECT role, count(*) AS n, sum(floor(length(text) / 3.5))::BIGINT AS tokens, sum(CASE WHEN length(text) > 700 THEN 1 ELSE 0 END)::BIGINT AS over FROM conversations GROUP BY 1")
def m_07(spark, sf_dir):
    tokens = F.floor(F.length("text") / 3.5)
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(tokens).alias("tokens"), F.count_if(F.length("text") > 700).alias("over"))


@query("SELECT conv_id, turn, role, length(text)::INTEGER AS chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def v_12(spark, sf_dir):
    """The last turn of each conversation, as a batch's results are collected."""
    c = table(spark, sf_dir, "conversations").withColumn("chars", F.length("text")).withColumn("last", F.col("turn"))
    return dedup.latest(c, ["conv_id"], ["last", "role", "chars"], "turn").withColumnRenamed("last", "turn")


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1 - toxic) AS agree, round(100.0 * count(*) FILTER (quality = 1 - toxic) / count(*), 2) AS percent FROM labels")
def agg_24(spark, sf_dir):
    same = F.count_if(F.col("quality") == 1 - F.col("toxic"))
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), same.alias("agree"), F.round(100.0 * same / F.count("*"), 2).alias("percent"))


@query("""SELECT doc_id, CASE quality WHEN 1 THEN 1 ELSE 3 END AS old_index, CASE toxic WHEN 1 THEN 4 ELSE 2 END AS new_index,
  CASE WHEN quality = 1 OR toxic = 1 THEN 'downgrade' ELSE 'upgrade' END AS direction,
  CASE WHEN quality = 1 THEN CASE toxic WHEN 1 THEN 'flawed' ELSE 'adequate' END ELSE CASE toxic WHEN 1 THEN 'flawed' ELSE 'weak' END END AS resolved FROM labels""")
def v_07(spark, sf_dir):
    """The second look may only lower a rating (m_06 gives the places)."""
    old = F.when(F.col("quality") == 1, "Strong").otherwise("weak")
    new = F.when(F.col("toxic") == 1, "junk").otherwise("moderate")
    return table(spark, sf_dir, "labels").select(
        "doc_id", ratings.index(old).cast("int").alias("old_index"), ratings.index(new).cast("int").alias("new_index"),
        ratings.direction(old, new).alias("direction"), ratings.resolved(old, new, F.lit(False)).alias("resolved"),
    )


RATINGS = View(
    "labelled",
    {
        "k": "doc_id", "kind": "CASE WHEN lang = 'en' THEN 'journal_article' ELSE 'handbook' END", "rating": pick("n_chars", ["landmark", "weak", "moderate", "not_applicable", "odd", "", "strong"]),
        "confidence": "CASE quality WHEN 0 THEN 'low' WHEN 1 THEN 'High' END", "escalated": "coalesce(toxic, 0) = 1", "forced": "doc_id % 11 = 0",
        "justification": "CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE substring(text, 1, 80) END", "notes": "CASE WHEN doc_id % 3 = 0 THEN '' ELSE substring(text, 81, 80) END",
    },
)


@query(f"""WITH {RATINGS.sql('t')} SELECT k, CASE WHEN forced THEN 'run:forced' WHEN starts_with(rating, 'not_') THEN 'skip:non_ratable_document'
  WHEN rating IN ('weak', 'flawed') THEN 'skip:clear_low_rating:' || rating WHEN rating IN ('landmark', 'strong', 'adequate') THEN 'run:rating_tier:' || rating
  WHEN lower(coalesce(confidence, 'medium')) = 'low' THEN 'run:low_confidence' WHEN escalated THEN 'run:escalation_pending' ELSE 'skip:default_skip' END AS decision FROM t""")
def flt_34(spark, sf_dir):
    c = F.col
    return RATINGS.df(spark, sf_dir).select("k", ratings.second_look(c("rating"), c("confidence"), c("escalated"), c("forced")).alias("decision"))


@query(f"""WITH {RATINGS.sql('t')}, n AS (SELECT *, CASE rating WHEN 'moderate' THEN 'adequate' ELSE rating END AS r, trim(justification) AS j FROM t)
SELECT k, CASE WHEN kind = 'handbook' AND r = 'not_applicable' AND j <> '' THEN 'complete:non_ratable_complete' WHEN r = '' THEN 'open:missing_rating'
  WHEN j = '' THEN 'open:missing_rating_justification' WHEN r = 'not_applicable' THEN 'complete:non_ratable_complete'
  WHEN r NOT IN ('landmark', 'strong', 'adequate', 'weak', 'flawed') THEN 'open:invalid_or_unknown_rating:' || r
  WHEN notes = '' THEN 'open:missing_red_team_notes' ELSE 'complete:research_eval_complete' END AS state FROM n""")
def flt_23(spark, sf_dir):
    c = F.col
    return RATINGS.df(spark, sf_dir).select("k", ratings.complete(c("kind"), c("rating"), c("justification"), c("notes")).alias("state"))


def _vectors(spark, sf_dir, paper, top_k, width=60):
    e = table(spark, sf_dir, "embeddings")
    return retrieval.vector_search(e, e.filter("vec_id = 0"), "vec_id", "embedding", paper, width, top_k)


_NEAR = """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
n AS (SELECT vec_id, vec_id // 5 AS paper, list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS d2
  FROM embeddings, q ORDER BY d2, vec_id LIMIT 60),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY paper ORDER BY d2, vec_id) = 1)
"""


@query(_NEAR + "SELECT paper, vec_id, round(1 - d2, 4) AS score FROM b ORDER BY d2, vec_id LIMIT 12")
def top_03(spark, sf_dir):
    found = _vectors(spark, sf_dir, F.floor(F.col("vec_id") / 5), 12)
    return found.select("paper", "vec_id", F.round("score", 4).alias("score"))


@query(_NEAR + "SELECT paper, vec_id FROM b")
def win_03(spark, sf_dir):
    return _vectors(spark, sf_dir, F.floor(F.col("vec_id") / 5), 1000).select("paper", "vec_id")


@query(_NEAR + ", l AS (SELECT n.*, label FROM n JOIN embeddings USING (vec_id)) SELECT label, count(*) AS n FROM l GROUP BY 1")
def t_06(spark, sf_dir):
    """What labels the nearest chunks have: the search joined back to its rows."""
    near = _vectors(spark, sf_dir, F.col("vec_id"), 60)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label").join(near, "vec_id").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 4) AS norm FROM embeddings GROUP BY 1")
def m_05(spark, sf_dir):
    norm = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda t, x: t + x * x))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm), 4).alias("norm"))


@query("""WITH b AS (SELECT conv_id, turn, length(text) AS n FROM conversations)
SELECT conv_id, count(*) FILTER (n < 200) AS short, count(*) FILTER (n >= 200) AS long, round(count(*) FILTER (n < 200) * 100.0 / count(*), 2) AS percent FROM b GROUP BY 1""")
def agg_03(spark, sf_dir):
    short = F.count_if(F.length("text") < 200)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        short.alias("short"), F.count_if(F.length("text") >= 200).alias("long"), F.round(short * 100.0 / F.count("*"), 2).alias("percent")
    )
