"""Past states of a table from its log, and deletions that took more than they should.

The log has id, at (the order of events, unique for an id), kind (``put`` or
``delete``) and sha, the digest of the content. A state is a fold of the log, so a
document with very many events is summed up before the shuffle.

Defined cases: events without an id do not count; a deletion of what is not there
changes nothing; content without a digest cannot be compared; an empty log is an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _last(events: DataFrame, at: int) -> DataFrame:
    """The last event of each document until a moment, and what was put last."""
    order, put = F.col("at"), F.when(F.col("kind") == "put", F.struct("at", "sha"))
    until = events.filter(F.col("id").isNotNull() & (F.col("at") <= at))
    return until.groupBy("id").agg(F.max_by("kind", order).alias("kind"), F.max("at").alias("at"), F.max(put).alias("put")).select("id", "kind", "at", F.col("put.sha").alias("sha"), F.col("put").isNotNull().alias("known"))


def state_at(events: DataFrame, at: int) -> DataFrame:
    """id and sha of the documents that were there at a moment."""
    return _last(events, at).filter("kind = 'put'").select("id", "sha")


def deletions(events: DataFrame, at: int) -> DataFrame:
    """id, sha and verdict of the documents that are gone: ``confirmed_duplicate`` if another row still holds
    the content, ``restore`` if none does, ``unknown_content`` if it has no digest."""
    last = _last(events, at)
    gone = last.filter("kind = 'delete' AND known").select("id", "sha")
    held = last.filter("kind = 'put' AND sha IS NOT NULL").select("sha").distinct().withColumn("held", F.lit(True))
    verdict = F.when(F.col("sha").isNull(), "unknown_content").when(F.col("held"), "confirmed_duplicate").otherwise("restore")
    return gone.join(held, "sha", "left").select("id", "sha", verdict.alias("verdict"))


def restored(events: DataFrame, at: int) -> DataFrame:
    """The state at a moment with what was wrongly deleted put back: of rows with one content the smallest id."""
    back = deletions(events, at).filter("verdict = 'restore'").groupBy("sha").agg(F.min("id").alias("id")).select("id", "sha")
    return state_at(events, at).unionByName(back)
