"""Queries that apply the text operators to the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import align, bpe, forest, licenses, minhash, mixing, packing, quality, repeats, resample, scratch, simhash, token_counts, warc


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer's file lies on this machine; every node has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assessed(docs).select("doc_id", *quality.RESULT, "base_failed", "kept")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch.shared_dir(spark)}/warc"
    warc.write(_table(spark, sf_dir, "pages"), path)
    found = warc.records(warc.read(spark, path))
    return found.select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    store = token_counts.Rollup(spark, f"{scratch.shared_dir(spark)}/rollup")
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    # texts are counted once and never shuffled: what follows joins the counts
    docs = token_counts.counted(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, "byte_bpe_50k-1")
    docs = scratch.keep(docs, "counted")
    store.commit("load", upserts=docs)
    store.commit("load", upserts=docs)  # committed before: changes nothing
    # labelled documents are taken back; those that are not toxic come again with their language unknown, then the good ones as they were
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").dropDuplicates(["doc_id"])
    again = docs.join(labels.filter("toxic = 0"), "doc_id")
    store.commit("taken_back", deleted=labels)
    store.commit("unsure", upserts=again.select(*docs.columns).withColumn("lang", F.lit(None).cast("string")))
    store.commit("revised", upserts=again.filter("quality = 1").select(*docs.columns))
    return store.totals()


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(_table(spark, sf_dir, "embeddings"))


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scored(_table(spark, sf_dir, "documents"))


def op11_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
