"""The registry of queries outside the training-data subpackage.

Each module of ``vellum.plans`` named here has ``QUERIES`` (name to callable)
and ``ORACLE`` (name to SQL text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.plans import articles, corpus, desk, evaluation, files, flagship, helpers, ladders, ledger, matching, papers, records, relations, upkeep, verdicts

MODULES = [flagship, corpus, ledger, relations, papers, evaluation, helpers, records, articles, matching, upkeep, desk, ladders, files, verdicts]


def _merged(parts: list[dict]) -> dict:
    """One table of all; a name that stands in two modules is an error."""
    out: dict = {}
    for part in parts:
        if twice := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= part
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged([m.QUERIES for m in MODULES])


def oracle_sql() -> dict[str, str]:
    return _merged([m.ORACLE for m in MODULES])
