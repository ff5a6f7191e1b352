"""The rating scale: labels, order, and the rules of the second look."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scale from best to worst, and other names for its steps.
SCALE = ["landmark", "strong", "adequate", "weak", "flawed"]
ALIASES = {"moderate": "adequate", "junk": "flawed"}
NON_RATABLE = ["not_applicable", "not_ratable_reference_material"]


def label(c: Column) -> Column:
    """Lower case, spaces and hyphens as one underscore, aliases resolved."""
    x = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s-]+", "_")
    for old, new in ALIASES.items():
        x = F.when(x == old, F.lit(new)).otherwise(x)
    return x


def index(c: Column) -> Column:
    """Place on the scale from 0, or null."""
    at = F.array_position(F.array(*map(F.lit, SCALE)), label(c))
    return F.when(at > 0, at - 1)


def direction(old: Column, new: Column) -> Column:
    o, n = index(old), index(new)
    return F.when(n > o, "downgrade").when(n < o, "upgrade").otherwise("unchanged")


def resolved(old: Column, final: Column, survived: Column) -> Column:
    """The final rating after the second look, which may only lower it."""
    lower = ~F.coalesce(survived, F.lit(True)) & (index(final) > index(old))
    return F.when(F.coalesce(lower, F.lit(False)), label(final)).otherwise(label(old))


def second_look(rating: Column, confidence: Column, escalated: Column, forced: Column) -> Column:
    """Why a rating gets a second look, or why it does not."""
    return (
        F.when(forced, "run:forced")
        .when(rating.startswith("not_"), "skip:non_ratable_document")
        .when(rating.isin("weak", "flawed"), F.concat(F.lit("skip:clear_low_rating:"), rating))
        .when(rating.isin("landmark", "strong", "adequate"), F.concat(F.lit("run:rating_tier:"), rating))
        .when(F.lower(F.coalesce(confidence, F.lit("medium"))) == "low", "run:low_confidence")
        .when(escalated, "run:escalation_pending")
        .otherwise("skip:default_skip")
    )


def complete(kind: Column, rating: Column, justification: Column, notes: Column) -> Column:
    """Whether an evaluation is complete, with the reason (rows without a stored body)."""
    r, j, n = label(rating), F.trim(F.coalesce(justification, F.lit(""))), F.trim(F.coalesce(notes, F.lit("")))
    non_ratable = r.isin(*NON_RATABLE)
    other_kind = F.regexp_replace(F.lower(F.coalesce(kind, F.lit(""))), "[ -]", "_").isin("reference_material", "manual", "handbook", "book")
    return (
        F.when(other_kind & non_ratable & (j != ""), "complete:non_ratable_complete")
        .when(r == "", "open:missing_rating")
        .when(j == "", "open:missing_rating_justification")
        .when(non_ratable, "complete:non_ratable_complete")
        .when(~r.isin(*SCALE), F.concat(F.lit("open:invalid_or_unknown_rating:"), r))
        .when(n == "", "open:missing_red_team_notes")
        .otherwise("complete:research_eval_complete")
    )
