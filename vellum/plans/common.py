"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.sources.tables import table

NOW = "2024-02-01 00:00:00"


class Literal:
    """A small fixed table that both engines get from the same rows."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self, name: str) -> str:
        """A common table expression of that name."""
        kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}
        fields = [f.split() for f in self.schema.split(", ")]
        value = lambda v, k: "CAST({} AS {})".format("NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'", kinds[k])
        rows = ", ".join("(" + ", ".join(value(v, k) for v, (_, k) in zip(row, fields)) + ")" for row in self.rows)
        return f"{name}({', '.join(f for f, _ in fields)}) AS (VALUES {rows})"


class View:
    """Rows made of a supplied table, by one text for both engines; ``SHA<x>SHA`` stands for the digest of x."""

    def __init__(self, source: str, columns: dict[str, str], where: str | None = None):
        self.source, self.columns, self.where = source, columns, where

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _source(spark, sf_dir, self.source)
        made = rows.filter(self.where) if self.where else rows
        return made.selectExpr(*[f"{e.replace('SHA<', 'sha2(').replace('>SHA', ', 256)')} AS {n}" for n, e in self.columns.items()])

    def select(self) -> str:
        columns = ", ".join(f"{e.replace('SHA<', 'sha256(').replace('>SHA', ')')} AS {n}" for n, e in self.columns.items())
        return f"SELECT {columns} FROM {SOURCES.get(self.source, self.source)}{' WHERE ' + self.where if self.where else ''}"

    def sql(self, name: str) -> str:
        """A common table expression of that name."""
        return f"{name} AS ({self.select()})"


class Union(View):
    """Rows of several views with the same columns."""

    def __init__(self, *views: View):
        self.views = views

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.views[0].df(spark, sf_dir)
        for v in self.views[1:]:
            out = out.unionByName(v.df(spark, sf_dir))
        return out

    def select(self) -> str:
        return " UNION ALL ".join(v.select() for v in self.views)


#: Documents with their labels, where they have any.
SOURCES = {"labelled": "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"}


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "labelled":
        return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return table(spark, sf_dir, name)


def word(n: int, of: str = "text") -> str:
    """The nth word of ASCII letters of a column, with a capital; blank where there is none."""
    found = f"regexp_extract(coalesce({of}, ''), '^[^A-Za-z]*{'[A-Za-z]+[^A-Za-z]+' * (n - 1)}([A-Za-z]+)', 1)"
    return f"(upper(substring({found}, 1, 1)) || lower(substring({found}, 2, 30)))"


def pick(key: str, values: list[str | None]) -> str:
    """One of the values in turn, by a number."""
    literal = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"(CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {literal(v)}" for k, v in enumerate(values)) + " END)"


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def sql_strip(x: str) -> str:
    return STRIP.format(x)


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def sql_tokens(x: str, least: int = 3) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{{least},}}')))"
