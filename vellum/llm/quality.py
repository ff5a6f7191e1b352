"""Quality rules: one threshold table compiled into one Spark projection.

Every measure is a built-in Spark expression, so a document is judged inside
the JVM, in one narrow stage, without a shuffle and without user functions.

Defined cases: a null or empty text has no words, measures of zero and fails
the base rule (fewer than ``MIN_WORDS`` words); null ids pass through; equal
rows give equal results, one for each row; the input's other columns are
kept by :func:`assessed` unless their name is one of the result's, which
:func:`assessed` then overwrites; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MARKS = SYMBOLS + "!"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in a is that it for on with as was by be this are from or at which",
    "fr": "le la les de des du et en un une que qui dans pour sur par au est avec pas ce il",
    "de": "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch",
    "es": "el la los las de que y en un una por con para del se su al es lo como más o",
}


@dataclass(frozen=True)
class Rule:
    """Keep a text if ``measure`` lies within [least, most]; measures are ratios or counts."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The production thresholds. ``measure`` names an entry of :func:`ratios`.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("marks", "marks_per_word", None, 0.2),
    Rule("stop_words", "stop_word_ratio", 0.05, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("repeated_words", "repeat_word_ratio", None, 0.5),
    Rule("capitals", "capital_word_ratio", None, 0.6),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chars_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` belong to ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text.

    The windows are sorted with their positions, so that equal ones are
    neighbours; the positions that have an equal neighbour are then merged,
    each covering up to three words that the next does not cover.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(
        starts,
        lambda i: F.struct(
            F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")
        ),
    )

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda total, x: total + x)

    def repeated(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, k: (x["w"] == F.get(ordered, k + 1)["w"]) | ((k > 0) & (x["w"] == F.get(ordered, k - 1)["w"])),
        )
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), repeated))


def measures(text: Column) -> Column:
    """A struct of the counts that the rules draw on, each of the whole text."""
    stops = F.array(*[F.lit(w) for w in sorted({w for ws in STOP_WORDS.values() for w in ws.split()})])

    def of(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            (F.length(text) - _chars_of(text, SPACE)).cast("long").alias("word_chars"),
            _chars_of(text, SYMBOLS).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            _chars_of(text, MARKS).cast("long").alias("n_marks"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(words, lambda w: F.array_contains(stops, F.lower(w)))).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w: (F.length(w) > 2) & (w == F.upper(w)) & (w != F.lower(w))))
            .cast("long")
            .alias("n_capital_words"),
        )

    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    return let(words, lambda ws: let(lines, lambda ls: of(ws, ls)))


def ratios(m: Column) -> dict[str, Column]:
    """The measures that rules may name."""
    words, lines = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["n_lines"], F.lit(1))
    return {
        "n_words": m["n_words"].cast("double"),
        "mean_word_chars": m["word_chars"] / words,
        "marks_per_word": m["n_marks"] / words,
        "stop_word_ratio": m["n_stop_words"] / words,
        "dup_line_ratio": m["n_dup_lines"] / lines,
        "repeat_word_ratio": m["n_repeat_words"] / words,
        "capital_word_ratio": m["n_capital_words"] / words,
    }


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of ``base_failed``, ``failed_rules`` and ``kept`` for a struct of measures."""
    by_name = ratios(m)
    base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    broken = []
    for rule in rules:
        value = by_name[rule.measure]
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | (value < rule.least)
        if rule.most is not None:
            bad = bad | (value > rule.most)
        broken.append(F.when(bad, F.lit(rule.name)))
    failed = F.array_compact(F.array(*broken))
    return let(
        F.struct(base.alias("b"), failed.alias("f")),
        lambda v: F.struct(
            v["b"].alias("base_failed"), v["f"].alias("failed_rules"), (~v["b"] & (F.size(v["f"]) == 0)).alias("kept")
        ),
    )


def assess(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Measures and verdict of a text as one struct of two: ``m`` and ``v``."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return let(whole, lambda t: let(measures(t), lambda m: F.struct(m.alias("m"), verdict(m, rules).alias("v"))))


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def assessed(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``kept`` and ``failed_rules`` of each text."""
    judged = docs.withColumn("__assessed", assess(F.col(text_col), rules))
    m, v = F.col("__assessed.m"), F.col("__assessed.v")
    new = {c: m[c] for c in RESULT} | {c: v[c] for c in ("base_failed", "kept", "failed_rules")}
    return judged.withColumns(new).drop("__assessed")


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes the base rule and all thresholds, with their own columns."""
    return docs.filter(assess(F.col(text_col), rules)["v"]["kept"])
