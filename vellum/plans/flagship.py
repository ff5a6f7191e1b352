"""Coverage and acceptance of documents: the first report over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import gates
from vellum.functions.text import strip
from vellum.plans.common import Literal, sql_strip
from vellum.sources.tables import table


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, rating state, length, coverage and acceptance per document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    no, one = F.lit(False), F.lit(1)
    length = F.length(strip(F.col("text")))
    status = gates.coverage(F.col("n"), F.lit("TEXT_OK"), no, one, one)
    may = gates.permissions(F.col("coverage_status"), F.col("n"), no, no)
    action = gates.acceptance(
        F.col("coverage_status"), F.col("n"), F.lit("TEXT_OK"), no, F.col("may"), F.lit("article"), F.coalesce(F.col("toxic") == 1, no), no, no
    )
    rating = F.when(F.col("quality") == 1, "strong").when(F.col("quality") == 0, "weak").otherwise("NO_RATING")
    rows = docs.select("doc_id", "lang", length.alias("n")).join(labels, "doc_id", "left")
    rows = rows.withColumn("rating", rating).withColumn("coverage_status", status).withColumn("may", may)
    return rows.withColumn("action", action)


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        assessed(spark, sf_dir)
        .groupBy("lang", "coverage_status", "action")
        .agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_chars"), F.count_if(F.col("may.can_rate")).alias("n_ratable"))
    )


def c_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).select("doc_id", F.col("n").alias("n_chars_stripped"), "coverage_status", "may.can_rate", "may.can_not_applicable")


def c_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).select("doc_id", "rating", "action")


def agg_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).groupBy("rating").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rating")


def agg_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("rating") == "NO_RATING", "no_rating").when((F.col("rating") == "strong") & (F.col("toxic") == 1), "needs_red_team").otherwise("fully_evaluated")
    return assessed(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def agg_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        assessed(spark, sf_dir)
        .groupBy("lang")
        .agg(
            F.count("*").alias("total"), F.count_if(F.col("n") == 0).alias("missing"), F.count_if(F.col("n") < 500).alias("very_short"),
            *[F.count_if(F.col("coverage_status") == s).alias(s.lower()) for s in ("COMPLETE_ENOUGH", "PARTIAL_BUT_USABLE", "INSUFFICIENT_FOR_EVALUATION")],
        )
    )


CASES = Literal(
    "k int, length int, extractor string, journal boolean, sections int, pages int, kind string, preclassified boolean, duplicate boolean, identity_problem boolean",
    [
        (k, n, e, j, s, p, kind, pre, dup, bad)
        for k, (n, e, j, s, p, kind, pre, dup, bad) in enumerate(
            [(n, e, j, s, p, kind, pre, False, False) for n in (199, 200, 1999, 2000, 7999, 8000) for e in ("TEXT_OK", "OCR_FAILED", "EXTRACTOR_CRASHED") for j in (True, False) for s, p in ((1, 1), (2, 1), (2, 2)) for kind, pre in (("journal_article", False), ("handbook", True))]
            + [(9000, "OCR_REQUIRED", False, 2, 1, "article", False, d, b) for d in (True, False) for b in (True, False)]
        )
    ],
)


def _cases(spark: SparkSession) -> DataFrame:
    c = F.col
    reference = c("kind").isin(*gates.REFERENCE_KINDS)
    rows = CASES.df(spark).withColumn("status", gates.coverage(c("length"), c("extractor"), c("journal"), c("sections"), c("pages")))
    rows = rows.withColumn("may", gates.permissions(c("status"), c("length"), c("journal"), reference))
    action = gates.acceptance(c("status"), c("length"), c("extractor"), c("journal"), c("may"), c("kind"), c("duplicate"), c("identity_problem"), c("preclassified"))
    return rows.select("k", "status", "may.*", action.alias("action"))


def c_16_17_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every branch of both ladders, on literal rows."""
    return _cases(spark)


_KINDS = ", ".join(f"'{k}'" for k in gates.REFERENCE_KINDS)
_COVERAGE = "CASE WHEN n < 200 THEN 'INSUFFICIENT_FOR_EVALUATION' WHEN n >= 8000 THEN 'COMPLETE_ENOUGH' WHEN n >= 2000 THEN 'PARTIAL_BUT_USABLE' ELSE 'INSUFFICIENT_FOR_EVALUATION' END"
_BASE = f"""
WITH a AS (
  SELECT d.doc_id, lang, length({sql_strip('text')}) AS n, quality, toxic,
         CASE quality WHEN 1 THEN 'strong' WHEN 0 THEN 'weak' ELSE 'NO_RATING' END AS rating
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
b AS (SELECT *, {_COVERAGE} AS coverage_status FROM a),
c AS (
  SELECT *, coverage_status <> 'INSUFFICIENT_FOR_EVALUATION' AS can_rate,
         CASE WHEN toxic = 1 THEN 'REJECT_DUPLICATE' WHEN coverage_status = 'INSUFFICIENT_FOR_EVALUATION' THEN 'REJECT_INSUFFICIENT_EVIDENCE'
              ELSE 'ACCEPT_RESEARCH' END AS action
  FROM b)
"""
QUERIES = {
    "coverage_report": coverage_report, "c_16": c_16, "c_17": c_17, "agg_02": agg_02, "agg_04": agg_04, "agg_05": agg_05,
    "c_16_17_cases": c_16_17_cases,
}
ORACLE = {
    "coverage_report": _BASE + "SELECT lang, coverage_status, action, count(*) AS n_docs, avg(n) AS avg_chars, count(*) FILTER (can_rate) AS n_ratable FROM c GROUP BY ALL",
    "c_16": _BASE + "SELECT doc_id, n::INTEGER AS n_chars_stripped, coverage_status, can_rate, true AS can_not_applicable FROM c",
    "c_17": _BASE + "SELECT doc_id, rating, action FROM c",
    "agg_02": _BASE + "SELECT rating, count(*) AS n FROM c GROUP BY 1",
    "agg_04": _BASE + "SELECT CASE WHEN rating = 'NO_RATING' THEN 'no_rating' WHEN rating = 'strong' AND toxic = 1 THEN 'needs_red_team' ELSE 'fully_evaluated' END AS state, count(*) AS n FROM c GROUP BY 1",
    "agg_05": _BASE + """SELECT lang, count(*) AS total, count(*) FILTER (n = 0) AS missing, count(*) FILTER (n < 500) AS very_short,
       count(*) FILTER (coverage_status = 'COMPLETE_ENOUGH') AS complete_enough, count(*) FILTER (coverage_status = 'PARTIAL_BUT_USABLE') AS partial_but_usable,
       count(*) FILTER (coverage_status = 'INSUFFICIENT_FOR_EVALUATION') AS insufficient_for_evaluation FROM c GROUP BY 1""",
    "c_16_17_cases": f"""
WITH {CASES.sql('t')},
s AS (
  SELECT *, kind IN ({_KINDS}) AS ref,
    CASE WHEN extractor = 'OCR_REQUIRED' THEN 'OCR_REQUIRED' WHEN extractor = 'OCR_FAILED' THEN 'OCR_FAILED'
         WHEN extractor <> 'TEXT_OK' AND length < 200 THEN 'EXTRACTION_FAILED' WHEN length < 200 THEN 'INSUFFICIENT_FOR_EVALUATION'
         WHEN journal AND length < 8000 THEN CASE WHEN sections <> 1 AND pages > 1 THEN 'PARTIAL_NEEDS_RECOVERY' ELSE 'INSUFFICIENT_FOR_EVALUATION' END
         WHEN journal THEN CASE WHEN sections >= 2 THEN 'COMPLETE_ENOUGH' ELSE 'PARTIAL_BUT_USABLE' END
         WHEN length >= 8000 THEN 'COMPLETE_ENOUGH' WHEN length >= 2000 THEN 'PARTIAL_BUT_USABLE' ELSE 'INSUFFICIENT_FOR_EVALUATION' END AS status
  FROM t),
m AS (
  SELECT *, status IN ('COMPLETE_ENOUGH', 'PARTIAL_BUT_USABLE') AND (NOT journal OR length >= 2000) AND NOT (journal AND length < 8000 AND NOT ref) AS can_rate,
         (NOT journal OR ref) AND status NOT IN ('EXTRACTION_FAILED', 'OCR_REQUIRED', 'OCR_FAILED') AND NOT (journal AND length < 8000 AND NOT ref) AS can_not_applicable,
         status IN ('PARTIAL_NEEDS_RECOVERY', 'INSUFFICIENT_FOR_EVALUATION', 'EXTRACTION_FAILED') AS weak
  FROM s)
SELECT k, status, can_rate, can_not_applicable, ref AS can_reference,
  CASE WHEN duplicate THEN 'REJECT_DUPLICATE' WHEN identity_problem THEN 'REJECT_INSUFFICIENT_EVIDENCE'
       WHEN extractor IN ('OCR_FAILED', 'OCR_REQUIRED') THEN 'REJECT_NEEDS_RECOVERY'
       WHEN extractor <> 'TEXT_OK' AND length < 200 THEN 'REJECT_CORRUPT_OR_UNUSABLE'
       WHEN length < 200 AND NOT preclassified THEN 'REJECT_INSUFFICIENT_EVIDENCE'
       WHEN journal AND NOT can_rate AND NOT can_not_applicable AND NOT (preclassified AND ref)
         THEN CASE WHEN status IN ('PARTIAL_NEEDS_RECOVERY', 'OCR_REQUIRED', 'OCR_FAILED') THEN 'REJECT_NEEDS_RECOVERY' ELSE 'REJECT_INSUFFICIENT_EVIDENCE' END
       WHEN weak AND ((journal AND NOT (preclassified AND ref)) OR NOT preclassified)
         THEN CASE WHEN status = 'PARTIAL_NEEDS_RECOVERY' THEN 'REJECT_NEEDS_RECOVERY' ELSE 'REJECT_INSUFFICIENT_EVIDENCE' END
       WHEN (preclassified OR ref) AND ref AND (NOT journal OR can_not_applicable) THEN 'ACCEPT_REFERENCE'
       WHEN preclassified AND journal AND NOT ref THEN 'REJECT_INSUFFICIENT_EVIDENCE'
       WHEN can_rate THEN 'ACCEPT_RESEARCH' ELSE 'REJECT_INSUFFICIENT_EVIDENCE' END AS action
FROM m""",
}
