"""Changes of a table, each a new table: upsert, patch, delete, rollback, and a guard for them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.session import ensure_checkpoint_dir


def valid(rows: DataFrame, id_col: str, title_col: str) -> DataFrame:
    """``rows`` with the list of what is missing."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return rows.withColumn("errors", F.array_compact(F.array(F.when(blank(id_col), "missing_id"), F.when(blank(title_col), "missing_title"))))


def upsert(old: DataFrame, new: DataFrame, key: str, replace: bool = True) -> DataFrame:
    """``old`` with the rows of ``new``; a clash of keys replaces the row or, if strict, is an error."""
    if not replace and old.join(new, key, "left_semi").limit(1).count():
        raise ValueError("a key is present already")
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def patch(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``old`` with the columns that ``changes`` fills."""
    named = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = old.join(named, key, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*old.columns)


def delete(old: DataFrame, ids: DataFrame | None, key: str) -> tuple[DataFrame, DataFrame]:
    """What stays and what goes. No rows of ids delete nothing; None deletes everything."""
    if ids is None:
        return old.limit(0), old
    return old.join(ids.select(key).distinct(), key, "left_anti"), old.join(ids.select(key).distinct(), key, "left_semi")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name under the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}/{name}"


def delete_exported(old: DataFrame, ids: DataFrame | None, key: str, path: str) -> tuple[DataFrame, DataFrame]:
    """What stays, and what goes as it was exported to ``path`` in lines of JSON; fails if the counts do not add up."""
    stay, gone = delete(old, ids, key)
    gone.write.json(path)
    exported = old.sparkSession.read.schema(old.schema).json(path)
    if stay.count() + exported.count() != old.count():
        raise ValueError("rows were lost on deletion")
    return stay, exported


def field(value: Column, kind: str) -> Column:
    """A value as text: structs, maps and arrays as JSON, others as they print; null stays null."""
    return F.to_json(value) if kind.startswith(("struct", "map", "array")) else value.cast("string")


def serialised(rows: DataFrame) -> DataFrame:
    """``rows`` with each column as text."""
    return rows.select(*[field(F.col(c), kind).alias(c) for c, kind in rows.dtypes])


def dump(rows: DataFrame, name: str, date: str, path: str) -> DataFrame:
    """Write a line of JSON on the table, with its row count, and one for each row; return the lines as read back."""
    spark = rows.sparkSession
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(f"{path}/rows")
    lines = spark.read.text(f"{path}/rows")
    about = F.to_json(F.struct(F.lit(name).alias("exported_from"), F.lit(date).alias("export_date"), F.col("total")))
    lines.agg(F.count("*").alias("total")).select(about.alias("value")).write.text(f"{path}/metadata")
    return spark.read.text([f"{path}/metadata", f"{path}/rows"])


def append_events(rows: DataFrame, path: str) -> None:
    """Add ``rows`` to a log of JSON lines."""
    rows.write.mode("append").json(path)


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events of a log of JSON lines; blank lines and lines that hold no object are passed over."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    kind = F.schema_of_variant(F.try_parse_json("value"))
    return lines.filter(kind.startswith("OBJECT")).select(F.from_json("value", schema).alias("e")).select("e.*")


def export_texts(rows: DataFrame, text_col: str, extraction_col: str, path: str) -> DataFrame:
    """Rows with a text or an extraction as JSON lines, read back."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows.filter(some(text_col) | some(extraction_col)).write.json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def digest(rows: DataFrame, key: str) -> DataFrame:
    """Row count and an order-free checksum of whole rows."""
    field = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    row = F.sha2(F.concat(*[field(F.col(c).cast("string")) for c in sorted(rows.columns)]), 256)  # lengths keep fields and nulls apart
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))


def guarded(old: DataFrame, new: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """``new``, after checking that no row but the targets differs from ``old``."""
    rest = lambda df: digest(df.join(targets.select(key).distinct(), key, "left_anti"), key).first()
    if rest(old) != rest(new):
        raise ValueError("rows beyond the targets changed")
    return new
