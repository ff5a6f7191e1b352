"""Model payloads: JSON out of free text, required parts, ids, budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a payload and its classification must hold.
TOP = ["abstract_keywords", "basic_metadata", "classification", "methodology", "notes_and_flags", "statistical_analysis", "tags"]
CLASSIFICATION = [
    "applicable_standards_applied", "design_type_detected", "era_judgment", "key_strengths", "key_weaknesses", "primary_measures_detected",
    "rating", "rating_justification", "standards_violated",
]


def json_part(c: Column) -> Column:
    """From the first brace to the last of a model's answer, or null."""
    found = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def without_thoughts(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def missing(json: Column, path: str, names: list[str]) -> Column:
    """The names that an object at ``path`` lacks, in order."""
    at = F.get_json_object(json, path) if path != "$" else json
    return F.array_compact(F.array(*[F.when(F.coalesce(F.get_json_object(at, f"$.{n}"), F.lit("")).eqNullSafe(""), n) for n in names]))


def custom_id(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def pulled_rating(c: Column) -> Column:
    """The rating in raw output: by JSON, else by pattern."""
    by_json = F.get_json_object(json_part(c), "$.classification.rating")
    by_text = F.regexp_extract(c, '"?rating"?[ :=]+"?([a-z_]+)', 1)
    return F.lower(F.coalesce(by_json, F.when(by_text != "", by_text)))


def within_budget(sizes: Column, budget: int) -> Column:
    """Places of the blocks that fit, taken in order; one that does not fit is skipped and costs nothing."""
    zero = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<int>").alias("taken"))
    numbered = F.transform(sizes, lambda s, k: F.struct(s.cast("long").alias("s"), k.alias("k")))

    def step(acc, x):
        fits = acc["spent"] + x["s"] <= budget
        return F.when(
            fits, F.struct((acc["spent"] + x["s"]).alias("spent"), F.concat(acc["taken"], F.array(x["k"])).alias("taken"))
        ).otherwise(acc)

    return F.aggregate(numbered, zero, step)
