"""Reads of the named tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir``; any path scheme that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
