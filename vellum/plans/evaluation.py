"""Queries around a model call: inputs, payloads, costs, logs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from vellum.functions import identity, payloads
from vellum.plans.common import Literal, View, pick, sql_strip
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


_FULL = {n: "x" for n in payloads.TOP} | {"classification": {n: "y" for n in payloads.CLASSIFICATION} | {"rating": "Strong"}}
_SHORT = {k: v for k, v in _FULL.items() if k not in ("tags", "methodology")}
_SAID = [json.dumps(_FULL), "```json\n" + json.dumps(_SHORT) + "\n```", "<think>maybe\n{no}</think> rating: weak", json.dumps(_FULL | {"classification": {"rating": "flawed"}}), "no answer", "Sure! {\"classification\": {\"rating\": \"adequate\"}} Bye"]
# Answers: the turn's own words around what a model gives back.
ANSWERS = View("conversations", {"k": "conv_id * 1000 + turn", "answer": f"CASE WHEN turn % 2 = 1 THEN regexp_extract(text, '[A-Za-z]+ [A-Za-z]+', 0) || ' ' ELSE '' END || {pick('(conv_id + turn)', _SAID)}"})
A = f"WITH {ANSWERS.sql('t')}, j AS (SELECT k, answer, nullif(regexp_extract(answer, '(?s)(\\{{.*\\}})', 1), '') AS j FROM t) "


@query(A + "SELECT k, j AS part FROM j")
def s_30(spark, sf_dir):
    return ANSWERS.df(spark, sf_dir).select("k", payloads.json_part(c("answer")).alias("part"))


@query(A + "SELECT k, trim(regexp_replace(answer, '(?s)<think>.*?</think>', '', 'g')) AS plain FROM j")
def s_31(spark, sf_dir):
    return ANSWERS.df(spark, sf_dir).select("k", payloads.without_thoughts(c("answer")).alias("plain"))


@query(A + "SELECT k, lower(coalesce(CASE WHEN json_valid(j) THEN json_extract_string(j, '$.classification.rating') END, nullif(regexp_extract(answer, '\"?rating\"?[ :=]+\"?([a-z_]+)', 1), ''))) AS rating FROM j")
def x_40(spark, sf_dir):
    return ANSWERS.df(spark, sf_dir).select("k", payloads.pulled_rating(c("answer")).alias("rating"))


def _missing_sql(path: str, names: list[str]) -> str:
    items = ", ".join(f"CASE WHEN NOT coalesce(json_exists(v, '{path}.{n}'), false) THEN '{n}' END" for n in names)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ',')"


@query(A + f", v AS (SELECT k, CASE WHEN json_valid(j) THEN j::JSON END AS v FROM j) SELECT k, {_missing_sql('$', payloads.TOP)} AS missing_top, {_missing_sql('$.classification', payloads.CLASSIFICATION)} AS missing_class FROM v")
def v_02(spark, sf_dir):
    """Required parts that a payload lacks."""
    j = F.when(F.get_json_object(payloads.json_part(c("answer")), "$").isNotNull(), payloads.json_part(c("answer")))
    rows = ANSWERS.df(spark, sf_dir).withColumn("j", j)
    return rows.select(
        "k", F.array_join(payloads.missing(c("j"), "$", payloads.TOP), ",").alias("missing_top"),
        F.array_join(payloads.missing(c("j"), "$.classification", payloads.CLASSIFICATION), ",").alias("missing_class"),
    )


@query(f"SELECT doc_id, CASE WHEN n < 200 THEN 'insufficient_evidence_coverage' WHEN n <= 20000 THEN 'whole_text' ELSE 'evidence_pack' END AS strategy FROM (SELECT doc_id, length({sql_strip('text')}) AS n FROM documents)")
def v_01(spark, sf_dir):
    """How a text goes to a model (the budget set at 20,000 so that all arms occur)."""
    from vellum.functions.text import strip

    n = F.length(strip(c("text")))
    plan = F.when(n < 200, "insufficient_evidence_coverage").when(n <= 20000, "whole_text").otherwise("evidence_pack")
    return table(spark, sf_dir, "documents").select("doc_id", plan.alias("strategy"))


@query("""WITH RECURSIVE b AS (SELECT conv_id, list(length(text) ORDER BY turn) AS s FROM conversations GROUP BY 1),
f(conv_id, s, k, spent, taken) AS (SELECT conv_id, s, 0, 0::BIGINT, 0 FROM b UNION ALL
  SELECT conv_id, s, k + 1, CASE WHEN spent + s[k + 1] <= 1000 THEN spent + s[k + 1] ELSE spent END, CASE WHEN spent + s[k + 1] <= 1000 THEN taken + 1 ELSE taken END FROM f WHERE k < len(s))
SELECT conv_id, spent, taken::INTEGER AS taken FROM f WHERE k = len(s)""")
def win_10(spark, sf_dir):
    """Turns taken in order within 1,000 characters; one that does not fit is skipped. A conversation is a bounded group."""
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(sizes.alias("s"))
    fold = payloads.within_budget(c("s"), 1000)
    return rows.withColumn("f", fold).select("conv_id", "f.spent", F.size("f.taken").alias("taken"))


@query("SELECT conv_id || '|' || turn || '|' || role || '|v1' AS custom_id, split_part(conv_id || '|' || turn || '|' || role || '|v1', '|', 3) AS role FROM conversations")
def s_41(spark, sf_dir):
    made = payloads.custom_id(c("conv_id").cast("string"), c("turn").cast("string"), c("role"), F.lit("v1"))
    return table(spark, sf_dir, "conversations").select(made.alias("custom_id")).select("custom_id", F.split_part("custom_id", F.lit("|"), F.lit(3)).alias("role"))


MODULES = View("events", {"paper": "user_id", "module": "event_type", "light": pick("event_id", ["Green", "possible problems detected", "info", "red", "", "fail", None]), "rows": "cast(CASE WHEN value > 20 THEN 3 ELSE 0 END AS INT)"})
_LIGHT = "coalesce(CASE lower(trim(light)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in identity.LIGHTS.items()) + " END, '')"


@query(f"WITH {MODULES.sql('m')}, l AS (SELECT *, {_LIGHT} AS l FROM m) SELECT paper, count(*) FILTER (l = 'red') AS red, count(*) FILTER (l = 'green') AS green, count(*) FILTER (l IN ('red', 'yellow', 'fail') OR (l = 'info' AND rows > 0)) AS urgent FROM l GROUP BY 1")
def agg_26(spark, sf_dir):
    m = MODULES.df(spark, sf_dir).withColumn("l", identity.lookup(F.lower(F.trim("light")), identity.LIGHTS, ""))
    urgent = c("l").isin("red", "yellow", "fail") | ((c("l") == "info") & (c("rows") > 0))
    return m.groupBy("paper").agg(F.count_if(c("l") == "red").alias("red"), F.count_if(c("l") == "green").alias("green"), F.count_if(urgent).alias("urgent"))


PRICES = Literal("model string, price_in double, price_out double", [("small", 0.8, 4.0), ("middle", 3.0, 15.0), ("large", 15.0, 75.0)])


@query(f"WITH {PRICES.sql('p')}, n AS (SELECT count(*) AS n FROM documents) SELECT model, round(n * 2 * (41000 / 1e6 * price_in + 3700 / 1e6 * price_out), 2) AS usd, round(n * 2 * (41000 / 1e6 * price_in + 3700 / 1e6 * price_out) * 0.5, 2) AS batch_usd FROM p, n")
def agg_23(spark, sf_dir):
    """What two passes over the corpus would cost."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    usd = c("n") * 2 * (F.lit(41000) / 1e6 * c("price_in") + F.lit(3700) / 1e6 * c("price_out"))
    return PRICES.df(spark).crossJoin(F.broadcast(n)).select("model", F.round(usd, 2).alias("usd"), F.round(usd * 0.5, 2).alias("batch_usd"))


LOG = View(
    "events",
    {
        "line": "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'OTHER | ' || event_type ELSE 'INPUT | id=' || event_id || ' strategy=' || event_type || CASE WHEN value > 10 THEN '_text' ELSE '' END || ' |' || "
        "CASE WHEN user_id % 2 = 0 THEN ' 900' ELSE '' END END"
    },
)


@query(f"WITH {LOG.sql('t')} SELECT regexp_extract(line, 'INPUT \\|.*strategy=([a-z_]+) \\|', 1) AS strategy, count(*) AS n FROM t WHERE regexp_matches(line, 'INPUT \\|.*strategy=') GROUP BY 1")
def src_12(spark, sf_dir):
    """A text log's lines, by what a pattern finds."""
    rows = LOG.df(spark, sf_dir).filter(c("line").rlike(r"INPUT \|.*strategy="))
    return rows.groupBy(F.regexp_extract("line", r"INPUT \|.*strategy=([a-z_]+) \|", 1).alias("strategy")).agg(F.count("*").alias("n"))


LADDER = View(
    "events",
    {"k": "event_id", "ladder": "'click,view,purchase,' || event_type || ',error'", "start": "CASE WHEN user_id % 3 = 0 THEN event_type WHEN user_id % 3 = 1 THEN 'purchase' ELSE 'none' END", "available": "'view,error,' || event_type"},
)


@query(f"""WITH {LADDER.sql('t')}, s AS (SELECT k, string_split(ladder, ',') AS l, string_split(available, ',') AS v, greatest(coalesce(list_position(string_split(ladder, ','), start), 1), 1) AS p FROM t),
u AS (SELECT k, list_filter(l[p:] || l[1:p - 1], lambda x: list_contains(v, x)) AS f FROM s)
SELECT k, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ',') AS ladder FROM u""")
def v_08(spark, sf_dir):
    """The ladder from its start on, then the rest, without what is unavailable or repeated."""
    rows = LADDER.df(spark, sf_dir).select("k", F.split("ladder", ",").alias("l"), F.split("available", ",").alias("v"), "start")
    p = F.greatest(F.array_position("l", c("start")), F.lit(1)).cast("int")
    turned = F.concat(F.slice("l", p, F.size("l")), F.slice("l", F.lit(1), p - 1))
    return rows.select("k", F.array_join(F.array_distinct(F.filter(turned, lambda x: F.array_contains("v", x))), ",").alias("ladder"))


@query("SELECT role, count(*) AS n, count(*) FILTER (length(trim(text)) > 0) AS ok FROM conversations GROUP BY 1")
def agg_25(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.length(F.trim("text")) > 0).alias("ok"))


@query("SELECT event_type || ':' || day AS custom_id, n FROM (SELECT event_type, (ts::DATE)::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1, 2)")
def v_13(spark, sf_dir):
    """Work by key and day, as a run planner counts what a ledger holds."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return e.select(F.concat_ws(":", "event_type", "day").alias("custom_id"), "n")
