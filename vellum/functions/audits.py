"""A second reader's audit: answers of either schema brought to one form, and checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import ratings
from vellum.functions.text import nz

# What a framework may be violated in.
VIOLATIONS = (
    "methodology", "sample_size", "statistical_rigor", "measurement_validity", "reporting_quality", "reproducibility", "overclaiming",
    "article_type_mismatch", "domain_fit", "historical_context", "insufficient_evidence", "none",
)
RATINGS = (*ratings.SCALE, *ratings.NON_RATABLE)


def audit(answer: Column, original_rating: Column) -> Column:
    """The audit of a JSON answer as a struct; null where the text is no JSON object.

    Newer keys go before older ones; a blank or a missing value falls to the next.
    Without a verdict the rating survives; without a direction it follows from the
    ratings; unknown violations are left out, and none left is ``none``.
    """
    j = F.when(F.trim(answer).startswith("{") & F.try_parse_json(answer).isNotNull(), answer)
    get = lambda k: F.get_json_object(j, f"$.{k}")
    first = lambda *keys: F.coalesce(*[nz(get(k)) for k in keys], F.lit(""))
    original = ratings.label(original_rating)
    final = ratings.label(F.coalesce(*[nz(get(k)) for k in ("final_rating", "red_team_rating", "recommended_rating")], original))
    true = lambda k: get(k).isNotNull() & ~F.lower(get(k)).isin("false", "0", "")
    survived = F.when(get("survived_red_team").isNotNull(), true("survived_red_team")).when(get("red_team_survival").isNotNull(), true("red_team_survival")).otherwise(True)
    summary = F.trim(first("red_team_summary", "red_team_notes", "change_reason"))
    said = F.trim(first("change_reason", "downgrade_reason"))
    fallen = ~survived & (final != original)
    reason = F.when(said != "", said).when(fallen, F.when(summary != "", F.substring(summary, 1, 500)).otherwise("Red-team downgrade"))
    changed = F.when(get("rating_changed").isNotNull(), true("rating_changed")).otherwise(final != original)
    told = F.lower(F.trim(F.coalesce(get("change_direction"), F.lit(""))))
    direction = F.when(told.isin("upgrade", "downgrade", "unchanged"), told).otherwise(F.coalesce(ratings.direction(original, final), F.lit("unchanged")))
    listed = lambda k: F.coalesce(F.from_json(F.when(get(k).startswith("["), get(k)), "array<string>"), F.array().cast("array<string>"))
    points = F.filter(F.transform(listed("key_attack_points"), lambda x: F.trim(x)), lambda x: x != "")
    wrong = F.when(get("framework_violation").startswith("["), listed("framework_violation")).otherwise(F.array(F.coalesce(get("framework_violation"), F.lit("none"))))
    wrong = F.filter(F.transform(wrong, lambda x: F.lower(F.trim(x))), lambda x: x.isin(*VIOLATIONS))
    sure = F.lower(F.trim(F.coalesce(nz(get("confidence")), F.lit("medium"))))
    made = F.struct(
        original.alias("original_rating"), final.alias("final_rating"), changed.alias("rating_changed"), direction.alias("change_direction"), reason.alias("change_reason"),
        F.when(F.size(wrong) > 0, wrong).otherwise(F.array(F.lit("none"))).alias("framework_violation"), F.when(sure.isin("high", "medium", "low"), sure).otherwise("medium").alias("confidence"),
        summary.alias("red_team_summary"), survived.alias("survived_red_team"), points.alias("key_attack_points"),
    )
    return F.when(j.isNotNull(), made)


def problem(made: Column, strict: bool = False) -> Column:
    """Why an audit cannot be used; null if it can."""
    bare = F.size(made["key_attack_points"]) == 0
    high = made["original_rating"].isin("landmark", "strong")
    return (
        F.when(made.isNull(), "red-team payload is not a JSON object")
        .when(~made["final_rating"].isin(*RATINGS), F.concat(F.lit("invalid final_rating: "), made["final_rating"]))
        .when(made["red_team_summary"] == "", "red_team_summary / red_team_notes required")
        .when(F.lit(strict) & high & bare, "key_attack_points required for LANDMARK/STRONG red-team")
    )
