"""Queries over verdicts of a model, written as JSON about the documents: checked, bounded, filled."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import verdicts
from vellum.plans.common import View, word

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _one(key: str, *values: str) -> str:
    """The first value for most rows, the others each for one length of text in 31."""
    return f"(CASE {key} % 31 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values[1:])) + f" ELSE {values[0]} END)"


_N = "n_chars"
_BULLET = f"""'{{"section":" methods ","claim":"' || {word(1)} || '","support":"' || CASE n_chars % 3 WHEN 0 THEN 'Supporting' WHEN 1 THEN 'contradicting' ELSE 'odd' END || '"}}'"""
_PARTS = {
    "rating": _one(_N, f"""CASE n_chars % 5 WHEN 0 THEN '"Strong"' WHEN 1 THEN '" not applicable"' WHEN 2 THEN '"moderate"' WHEN 3 THEN '"weak"' ELSE '"Not-Ratable reference-material"' END""", """'"unheard"'""", "'null'"),
    "rating_justification": _one(f"({_N} + 5)", f"""'" ' || repeat({word(2)} || ' ', cast(n_chars % 900 AS INT) + 1) || '."'""", """'"  "'""", "'7'"),
    "confidence": _one(f"({_N} + 9)", """'"High"'""", """'"sure"'"""),
    "evidence_bullets": _one(f"({_N} + 12)", f"""'[' || {_BULLET} || repeat(',' || {_BULLET}, cast(n_chars % 15 AS INT)) || ']'""", "'[]'", """'["x"]'""", """'[{"section":"","claim":"a"}]'""", """'{}'""", """'[{"section":"a","claim":3}]'"""),
    "key_strengths": _one(f"({_N} + 18)", """'["a"' || repeat(',{"b":[1]}', cast(n_chars % 13 AS INT)) || ']'""", """'"a"'"""),
    "key_weaknesses": "'[]'", "standards_violated": "'[null]'", "primary_measures_detected": """'["EEG"]'""", "design_type_detected": _one(f"({_N} + 20)", """'"RCT"'""", "'null'"), "era_judgment": """'""'""",
}
_CLASS = "'{\"applicable_standards_applied\":[]' || " + " || ".join(f"',\"{n}\":' || {e}" for n, e in _PARTS.items()) + " || CASE WHEN n_chars % 31 = 24 THEN '}' ELSE ',\"x\":0}' END"
_CUT = f"replace({_CLASS}, CASE WHEN n_chars % 31 = 25 THEN 'era_judgment' ELSE '?' END, 'other')"
_JSON = f"""CASE WHEN n_chars % 31 = 26 THEN '[1]' WHEN n_chars % 31 = 27 THEN 'no json' ELSE '{{"schema_version":"' || CASE WHEN n_chars % 31 = 28 THEN 'v1' ELSE 'v2_compact' END || '","classification":' || CASE WHEN n_chars % 31 = 29 THEN '"strong","rating":"weak","key_strengths":["own"]' ELSE {_CUT} END
  || CASE WHEN n_chars % 31 = 30 THEN '' ELSE ',"notes_and_flags":null' END || ',"tags":' || CASE WHEN n_chars % 31 = 17 THEN '[]' ELSE '{{"domain":[]}}' END || '}}' END"""
VERDICTS = View("documents", {"doc_id": "doc_id", "answer": _JSON})
_J = f"WITH {VERDICTS.sql('a')}, j AS MATERIALIZED (SELECT doc_id, CASE WHEN json_valid(answer) THEN answer::JSON END AS j FROM a)"
_NEED = "['applicable_standards_applied', 'confidence', 'design_type_detected', 'era_judgment', 'evidence_bullets', 'key_strengths', 'key_weaknesses', 'primary_measures_detected', 'rating', 'rating_justification', 'standards_violated']"
_TRIM = "trim(coalesce(json_extract_string({0}, '{1}'), ''))"


@query(_J + f""", k AS (SELECT doc_id, j, json_type(j) AS kind, array_to_string(list_filter(['classification', 'notes_and_flags', 'tags'], lambda n: NOT list_contains(json_keys(j), n)), ',') AS top, array_to_string(list_filter({_NEED}, lambda n: NOT list_contains(coalesce(json_keys(j, '$.classification'), []), n)), ',') AS cls,
  regexp_replace(lower({_TRIM.format('j', '$.classification.rating')}), '[\\s-]+', '_', 'g') AS r, {_TRIM.format('j', '$.classification.rating_justification')} AS why, lower({_TRIM.format('j', '$.classification.confidence')}) AS sure, json_type(j, '$.classification.evidence_bullets') AS bk, json_extract(j, '$.classification.evidence_bullets[*]')[1:12] AS b FROM j),
m AS (SELECT *, CASE r WHEN 'moderate' THEN 'adequate' WHEN 'junk' THEN 'flawed' ELSE r END AS rating FROM k),
e AS (SELECT *, CASE WHEN kind IS DISTINCT FROM 'OBJECT' THEN 'not_an_object' WHEN json_extract_string(j, '$.schema_version') IS DISTINCT FROM 'v2_compact' THEN 'schema_version' WHEN top <> '' THEN 'missing_top:' || top WHEN json_type(j, '$.classification') <> 'OBJECT' THEN 'classification' WHEN cls <> '' THEN 'missing_classification:' || cls
  WHEN rating NOT IN ('landmark', 'strong', 'adequate', 'weak', 'flawed', 'not_applicable', 'not_ratable_reference_material') THEN 'rating:' || rating WHEN json_type(j, '$.classification.rating_justification') <> 'VARCHAR' OR why = '' THEN 'rating_justification' WHEN sure NOT IN ('high', 'medium', 'low') THEN 'confidence'
  WHEN json_type(j, '$.classification.applicable_standards_applied') <> 'ARRAY' THEN 'not_a_list:applicable_standards_applied' WHEN json_type(j, '$.classification.primary_measures_detected') <> 'ARRAY' THEN 'not_a_list:primary_measures_detected' WHEN json_type(j, '$.classification.standards_violated') <> 'ARRAY' THEN 'not_a_list:standards_violated'
  WHEN json_type(j, '$.classification.key_strengths') <> 'ARRAY' THEN 'not_a_list:key_strengths' WHEN json_type(j, '$.classification.key_weaknesses') <> 'ARRAY' THEN 'not_a_list:key_weaknesses' WHEN bk <> 'ARRAY' OR len(b) = 0 THEN 'evidence_bullets'
  WHEN len(list_filter(b, lambda x: json_type(x) <> 'OBJECT' OR coalesce(json_type(x, '$.section'), '') <> 'VARCHAR' OR coalesce(json_type(x, '$.claim'), '') <> 'VARCHAR' OR {_TRIM.format('x', '$.section')} = '' OR {_TRIM.format('x', '$.claim')} = '')) > 0 THEN 'evidence_bullet' WHEN json_type(j, '$.tags') <> 'OBJECT' THEN 'tags' END AS error FROM m)
SELECT doc_id, error, CASE WHEN error IS NULL THEN rating END AS rating, CASE WHEN error IS NULL THEN CASE WHEN length(why) > 2500 THEN substring(why, 1, 2497) || '...' ELSE why END END AS justification, CASE WHEN error IS NULL THEN sure END AS confidence, CASE WHEN error IS NULL THEN least(json_array_length(j, '$.classification.key_strengths'), 10)::INT END AS n_strengths,
  CASE WHEN error IS NULL THEN len(b)::INT END AS n_bullets, CASE WHEN error IS NULL THEN {_TRIM.format('b[1]', '$.section')} || ':' || {_TRIM.format('b[1]', '$.claim')} || ':' || CASE WHEN lower({_TRIM.format('b[1]', '$.support')}) IN ('supporting', 'contradicting') THEN lower({_TRIM.format('b[1]', '$.support')}) ELSE 'neutral' END END AS first_bullet FROM e""")
def v_04(spark, sf_dir):
    """Compact verdicts checked, made plain and bounded (V-04): the first error, or the parts."""
    v = VERDICTS.df(spark, sf_dir).select("doc_id", verdicts.compact(F.try_parse_json("answer")).alias("x")).select("doc_id", "x.error", c("x.verdict").alias("v"))
    b = F.get("v.evidence_bullets", F.lit(0))
    return v.select(
        "doc_id", "error", "v.rating", c("v.rating_justification").alias("justification"), "v.confidence", F.when(c("v").isNotNull(), F.size("v.key_strengths")).alias("n_strengths"), F.when(c("v").isNotNull(), F.size("v.evidence_bullets")).alias("n_bullets"),
        F.when(c("v").isNotNull(), F.concat(b["section"], F.lit(":"), b["claim"], F.lit(":"), b["support"])).alias("first_bullet"),
    )


_P = "CASE WHEN inside THEN json_extract_string(j, '$.classification.{0}') ELSE json_extract_string(j, '$.{0}') END"
_L = "coalesce(CASE WHEN inside THEN CASE WHEN json_type(j, '$.classification.{0}') = 'ARRAY' THEN json_array_length(j, '$.classification.{0}') END WHEN json_type(j, '$.{0}') = 'ARRAY' THEN json_array_length(j, '$.{0}') END, 0)::INT"


@query(_J + f""", i AS (SELECT doc_id, j, coalesce(json_type(j, '$.classification') = 'OBJECT', false) AS inside FROM j)
SELECT doc_id, coalesce(nullif({_P.format('rating')}, ''), 'adequate') AS rating, coalesce(nullif({_P.format('rating_justification')}, ''), 'Fast backfill: model returned incomplete schema.') AS justification, coalesce(nullif({_P.format('design_type_detected')}, ''), 'unknown') AS design, coalesce(nullif({_P.format('era_judgment')}, ''), 'not_assessed') AS era,
  {_L.format('key_strengths')} AS n_strengths, {_L.format('standards_violated')} AS n_violated, {_L.format('primary_measures_detected')} AS n_measures, coalesce(json_type(j, '$.tags') = 'OBJECT', false) AS tagged FROM i""")
def v_03(spark, sf_dir):
    """Verdicts with their gaps filled (V-03): parts of the top level where there is no classification, defaults, lists that are lists."""
    f = VERDICTS.df(spark, sf_dir).select("doc_id", verdicts.filled(F.try_parse_json("answer")).alias("f"))
    return f.select(
        "doc_id", "f.rating", c("f.rating_justification").alias("justification"), c("f.design_type_detected").alias("design"), c("f.era_judgment").alias("era"),
        F.size("f.key_strengths").alias("n_strengths"), F.size("f.standards_violated").alias("n_violated"), F.size("f.primary_measures_detected").alias("n_measures"), "f.tagged",
    )
