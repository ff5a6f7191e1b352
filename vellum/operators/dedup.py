"""Exact duplicates, survivors and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.sources.session import ensure_checkpoint_dir


def already_owned(staged: DataFrame, owned: DataFrame, key: str) -> DataFrame:
    """Staged rows whose key an owned row has."""
    return staged.join(owned.select(key).distinct(), key, "left_semi")


def not_owned(staged: DataFrame, owned: DataFrame, key: str) -> DataFrame:
    return staged.join(owned.select(key).distinct(), key, "left_anti")


def survivors(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order.

    The keys of the least rows are found by a partial aggregate, so a key with
    very many rows is summed up before the shuffle.
    """
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"))
    return rows.withColumn("__order", F.struct(*order)).join(best, keys).filter(F.col("__order") == F.col("__first")).drop("__order", "__first")


def groups(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """Size and first id of each key that several rows have."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).filter("n > 1")


def redirected(refs: DataFrame, rows: DataFrame, kept: DataFrame, key: str, id_col: str) -> DataFrame:
    """``refs`` with ids of dropped rows replaced by the id that their key kept."""
    to = rows.select(id_col, key).join(kept.select(key, F.col(id_col).alias("kept_id")), key)
    return refs.join(to.select(id_col, "kept_id"), id_col, "left").withColumn("kept_id", F.coalesce("kept_id", id_col))


def latest(rows: DataFrame, keys: list[str], value: list[str], *order: str) -> DataFrame:
    """The values of the last row per key, by the given order; a fold, so no key is gathered in one place."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("__last"))
    return last.select(*keys, "__last.*")


def ranked(rows: DataFrame, keys: list[str], most: int, *order: Column) -> DataFrame:
    """At most ``most`` rows per key, with their place ``rn``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)


def round_robin(rows: DataFrame, bucket: str, most: int, *order: Column) -> DataFrame:
    """Rows in turn from each bucket, ``most`` in all."""
    w = Window.partitionBy(bucket).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most).orderBy("rn", bucket).limit(most)


def connected(pairs: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``label``, the smallest node of its group, for every node of the pairs.

    Large and small stars in turn: links are led to the smallest neighbour, so they
    grow fewer with each round and a node with very many of them is summed up first.
    """
    least = lambda links: links.groupBy("u").agg(F.min("v").alias("m"))

    def large(links: DataFrame) -> DataFrame:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = least(both).select("u", F.least("u", "m").alias("m"))
        return both.filter("v > u").join(to, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(links: DataFrame) -> DataFrame:
        to = least(links)
        rest = links.join(to, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return rest.unionByName(to.select("u", F.col("m").alias("v"))).distinct()

    ensure_checkpoint_dir(pairs.sparkSession)
    known = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    links = known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    nodes = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    now, seen = links.filter("u <> v").distinct().checkpoint(), None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return nodes.join(now.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("label"))
        seen, now = mark, small(large(now)).checkpoint()
    raise RuntimeError("the groups did not settle")
