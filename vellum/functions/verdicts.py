"""Verdicts of a model as JSON of unknown shape: the compact form checked and bounded, gaps of the full form filled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.identity import rating_label
from vellum.functions.payloads import CLASSIFICATION
from vellum.functions.titles import first_of

# What a compact verdict must hold, and its bounds.
COMPACT_TOP = ("classification", "notes_and_flags", "tags")
COMPACT_CLASSIFICATION = tuple(sorted([*CLASSIFICATION, "confidence", "evidence_bullets"]))
LISTS = ("applicable_standards_applied", "primary_measures_detected", "standards_violated", "key_strengths", "key_weaknesses")
RATINGS = ("landmark", "strong", "adequate", "weak", "flawed", "not_applicable", "not_ratable_reference_material")
MOST_JUSTIFICATION, MOST_SECTION, MOST_CLAIM, MOST_BULLETS, MOST_ITEMS = 2500, 80, 400, 12, 10
# What stands in for parts that a short answer leaves out.
DEFAULTS = {
    "rating": "adequate",
    "rating_justification": "Fast backfill: model returned incomplete schema.",
    "design_type_detected": "unknown",
    "era_judgment": "not_assessed",
}


def kind(v: Column, path: str = "$") -> Column:
    """What stands at a path: OBJECT, ARRAY, STRING, VOID (a null), another type; null if there is nothing."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)


def _text(v: Column, path: str) -> Column:
    return F.trim(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))


def bounded(c: Column, most: int) -> Column:
    """A text of at most ``most`` characters, its end marked if it was cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def _lacking(v: Column, path: str, names: tuple[str, ...]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(kind(v, f"{path}.{n}").isNull(), n) for n in names])), ",")


def compact(v: Column) -> Column:
    """A compact verdict (a variant; null if it was no JSON): the first error, or null and the bounded parts.

    Keys that hold a null count as present; a rating in another spelling is made plain, other kinds of support are neutral.
    """
    at = "$.classification"
    top, cls = _lacking(v, "$", COMPACT_TOP), _lacking(v, at, COMPACT_CLASSIFICATION)
    rating = rating_label(F.try_variant_get(v, f"{at}.rating", "string"))
    why, sure = _text(v, f"{at}.rating_justification"), F.lower(_text(v, f"{at}.confidence"))
    no_list = [(f"not_a_list:{n}", kind(v, f"{at}.{n}") != "ARRAY") for n in LISTS]
    bullets = F.try_variant_get(v, f"{at}.evidence_bullets", "array<variant>")
    shown = F.slice(bullets, 1, MOST_BULLETS)
    bad = lambda x, n: ~kind(x, f"$.{n}").eqNullSafe("STRING") | (_text(x, f"$.{n}") == "")
    wrong = F.exists(shown, lambda x: ~kind(x).eqNullSafe("OBJECT") | bad(x, "section") | bad(x, "claim"))
    support = lambda x: F.lower(_text(x, "$.support"))
    made = F.transform(
        shown,
        lambda x: F.struct(
            bounded(_text(x, "$.section"), MOST_SECTION).alias("section"),
            bounded(_text(x, "$.claim"), MOST_CLAIM).alias("claim"),
            F.when(support(x).isin("supporting", "contradicting"), support(x)).otherwise("neutral").alias("support"),
        ),
    )
    error = first_of(
        (
            ("not_an_object", ~kind(v).eqNullSafe("OBJECT")),
            ("schema_version", ~F.try_variant_get(v, "$.schema_version", "string").eqNullSafe("v2_compact")),
            (F.concat(F.lit("missing_top:"), top), top != ""),
            ("classification", kind(v, at) != "OBJECT"),
            (F.concat(F.lit("missing_classification:"), cls), cls != ""),
            (F.concat(F.lit("rating:"), rating), ~rating.isin(*RATINGS)),
            ("rating_justification", (kind(v, f"{at}.rating_justification") != "STRING") | (why == "")),
            ("confidence", ~sure.isin("high", "medium", "low")),
            *no_list,
            ("evidence_bullets", bullets.isNull() | (F.size(bullets) == 0)),
            ("evidence_bullet", wrong),
            ("tags", kind(v, "$.tags") != "OBJECT"),
        )
    )
    lists = [F.slice(F.try_variant_get(v, f"{at}.{n}", "array<variant>"), 1, MOST_ITEMS).alias(n) for n in LISTS]
    parts = F.struct(rating.alias("rating"), bounded(why, MOST_JUSTIFICATION).alias("rating_justification"), sure.alias("confidence"), made.alias("evidence_bullets"), *lists)
    return F.struct(error.alias("error"), F.when(error.isNull(), parts).alias("verdict"))


def filled(v: Column) -> Column:
    """A full verdict without gaps: the classification (of the top level, if it is no object) with its defaults, lists that are lists, and whether tags were there."""
    inside = kind(v, "$.classification").eqNullSafe("OBJECT")
    part = lambda n, to: F.when(inside, F.try_variant_get(v, f"$.classification.{n}", to)).otherwise(F.try_variant_get(v, f"$.{n}", to))
    texts = [F.when(F.coalesce(part(n, "string"), F.lit("")) == "", d).otherwise(part(n, "string")).alias(n) for n, d in DEFAULTS.items()]
    lists = [F.coalesce(part(n, "array<variant>"), F.array().cast("array<variant>")).alias(n) for n in LISTS]
    return F.struct(*texts, *lists, kind(v, "$.tags").eqNullSafe("OBJECT").alias("tagged"))
