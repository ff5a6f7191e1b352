"""An event ledger as a stream: its state per key, and counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def latest_state(events: DataFrame, key: str, ts: str, seq: str, value: str) -> DataFrame:
    """The last value per key so far (complete or update mode)."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(ts, seq)).alias("last_value"), F.max(ts).alias("last_ts"))


def windowed_counts(events: DataFrame, ts: str, kind: str, late: str = "1 day", every: str = "1 day") -> DataFrame:
    """Counts per kind and window, closed once ``late`` has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every), kind).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each key once within the lateness."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, key: str, order: list[str]):
    """Keep a table of the last row per key under ``path``, one version per batch, written anew if a batch is repeated."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [spark.read.parquet(f"{path}/v={number - 1}")] if number else []
        rows = batch
        for old in before:
            rows = rows.unionByName(old)
        rest = [c for c in rows.columns if c != key]
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")
        last.write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
