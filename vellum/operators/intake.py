"""Files that wait for intake, held against those that are owned or held already. All sides are met as one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owners(owned: DataFrame, disowned: DataFrame, digest: str, path: str) -> DataFrame:
    """The owner of each digest: its smallest path that is not among those disowned. Null digests own nothing."""
    kept = owned.filter(F.col(digest).isNotNull()).join(disowned.select(path).distinct(), path, "left_anti")
    return kept.groupBy(digest).agg(F.min(path).alias("owner"))


def duplicates(staged: DataFrame, owned: DataFrame, digest: str) -> DataFrame:
    """``staged`` with ``owner`` (of :func:`owners`), ``twins`` and ``duplicate``.

    Twins are the other staged rows of the digest, counted, never paired. A row is a duplicate if its digest has an
    owner or a twin, and is left alone otherwise (also without a digest).
    """
    alike = staged.filter(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("__n"))
    met = staged.join(owned.select(digest, "owner"), digest, "left").join(alike, digest, "left")
    twins = F.coalesce(F.col("__n") - 1, F.lit(0))
    return met.withColumn("twins", twins).withColumn("duplicate", F.col("owner").isNotNull() | (F.col("twins") > 0)).drop("__n")


def pending_twin(new: DataFrame, pending: DataFrame, key: str, digest: str, name: str) -> DataFrame:
    """``new`` with ``pending``, the smallest key of those held that have its digest or, in any case, its name; else null.

    Blank names and null digests match nothing. An OR of two keys is two joins, each with one row a key.
    """
    by_digest = pending.filter(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(key).alias("__d"))
    low = F.lower(name)
    by_name = pending.filter(F.trim(name) != "").groupBy(low.alias("__name")).agg(F.min(key).alias("__k"))
    met = new.join(by_digest, digest, "left").join(by_name, low == F.col("__name"), "left")
    return met.withColumn("pending", F.least("__d", "__k")).drop("__d", "__k", "__name")
