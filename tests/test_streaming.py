"""The ledger as a stream: the same state as the batch fold."""

from pyspark.sql import functions as F

from vellum.operators import dedup
from vellum.streaming import ledger

SCHEMA = "key string, ts timestamp, seq long, status string"


def write(spark, path, rows):
    spark.createDataFrame(rows, "key string, ts string, seq long, status string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


ROWS = [("a", "2024-01-01 00:00:00", 1, "queued"), ("a", "2024-01-02 00:00:00", 2, "done"), ("b", "2024-01-01 05:00:00", 3, "queued"), ("b", "2024-01-01 05:00:00", 4, "failed")]


def test_state_and_windows(spark, tmp_path):
    path = f"{tmp_path}/in"
    write(spark, path, ROWS)
    stream = ledger.latest_state(ledger.read(spark, path, SCHEMA), "key", "ts", "seq", "status")
    stream.writeStream.format("memory").queryName("state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r.key, r.last_value) for r in spark.table("state").collect()} == {("a", "done"), ("b", "failed")}
    counts = ledger.windowed_counts(ledger.read(spark, path, SCHEMA), "ts", "status")
    counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sum(r.n for r in spark.table("counts").collect()) == 4
    seen = ledger.first_seen(ledger.read(spark, path, SCHEMA), "key", "ts")
    seen.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("seen").count() == 2


def test_upserted_batches(spark, tmp_path):
    path, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    write(spark, path, ROWS[:3])
    ledger.upsert_batches(ledger.read(spark, path, SCHEMA), out, mark, "key", ["ts", "seq"]).awaitTermination()
    write(spark, path, ROWS[3:])
    ledger.upsert_batches(ledger.read(spark, path, SCHEMA), out, mark, "key", ["ts", "seq"]).awaitTermination()
    batch = spark.read.parquet(path)
    want = {(r.key, r.status) for r in dedup.latest(batch, ["key"], ["status"], "ts", "seq").collect()}
    assert {(r.key, r.status) for r in spark.read.parquet(f"{out}/v=1").collect()} == want
