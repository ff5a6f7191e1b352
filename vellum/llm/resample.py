"""Importance resampling towards a target by hashed word n-grams.

Features are runs of consecutive words. One scan of a text keeps a ring of the
checksum states of its last ``n`` word starts; each state is extended by a space
and the next word, so every feature's checksum is had without building its
bytes twice. Buckets of a text are kept as a table; corpus and target counts are
summed per task before they are shuffled, and are tables of ``buckets`` rows.

The draw is by noisy scores without replacement. Ranks are sums of counts of the
scores above (in two steps, by ranges of scores and within a range) and a place
among equal scores, so no task orders the whole corpus.

Defined cases: null and wordless texts have no features and weight 0; ties go to
the smaller id; rows that repeat an id are drawn each by itself and have places
that follow each other; rows without an id are scored under the text ``null`` and
come before others of the same score; an empty table gives an empty table, and
an empty target counts nothing; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.scratch import keep

BUCKETS = 10_000
GRAMS = 2
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
RANGE = 1024

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def buckets_of(tokens: list[bytes], grams: int, buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to ``grams`` words, repeats included."""
    ring: list[int] = []  # states of the last starts, the oldest first
    out: list[int] = []
    for w in tokens:
        more = b" " + w
        ring = [crc32(more, state) for state in ring[len(ring) >= grams :]]
        ring.append(crc32(w))
        out += ring
    return (np.array(out, np.uint32) % np.uint32(buckets)).astype(np.uint32)


def scanned(docs: DataFrame, grams: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_words, n_features and ``buckets``, 32-bit numbers in a binary column."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = named.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found = [], []
            for t in batch.column("text"):
                tokens = words(t.as_py())
                n_words.append(len(tokens))
                found.append(np.sort(buckets_of(tokens, grams, buckets)))
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array([len(f) for f in found], pa.int64())]
            columns.append(pa.array([f.tobytes() for f in found], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "buckets"])

    return named.mapInArrow(run, f"doc_id {id_type}, n_words long, n_features long, buckets binary")


def counts(scans: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket; each task sends its sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column("buckets"):
                total += np.bincount(np.frombuffer(b.as_buffer(), np.uint32), minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["bucket", "n"])

    summed = scans.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = summed.toArrow()  # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's log ratio of target to corpus, smoothed, in thousandths, rounded down."""
    k, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: (t + 1) * (s_all + k) / ((s + 1) * (t_all + k))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weighted(scans: DataFrame, gain: np.ndarray, id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = []
            for b in batch.column("buckets"):
                own = np.frombuffer(b.as_buffer(), np.uint32)
                weight.append(int(gain[own].sum()) // len(own) if len(own) else 0)
            yield batch.drop_columns(["buckets"]).append_column("weight", pa.array(weight, pa.int64()))

    return scans.mapInArrow(run, f"doc_id {id_type}, n_words long, n_features long, weight long")


def noise(id_column: str, seed: int):
    """Gumbel noise of an id, in thousandths, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``scored`` with ``rank`` of the drawn rows, from 1."""
    fit = scored.filter(F.col("n_words") >= least_words)
    per = fit.groupBy("score").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("score") / RANGE))
    per = keep(per, "score_counts")
    parts = per.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each range of scores
    higher = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", higher(Window.orderBy(F.desc("part"))).alias("before"))
    within = per.withColumn("above", higher(Window.partitionBy("part").orderBy(F.desc("score"))))
    above = within.join(parts, "part").select("score", (F.col("above") + F.col("before")).alias("above"))
    n = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    drawn = n * percent // 100
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    near = fit.join(above.filter(F.col("above") < drawn), "score").withColumn("rank", F.col("above") + place)
    taken = near.filter(F.col("rank") <= drawn).select("row", "rank")
    return scored.join(taken, "row", "left")


def resample(
    docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row of ``docs``.

    ``target`` has the texts to resemble in its column ``text``.
    """
    scans = keep(scanned(docs, grams, buckets, id_col, text_col), "buckets")
    wanted = scanned(target.select(F.lit(0).alias("none"), "text"), grams, buckets, "none", "text")
    gain = gains(counts(scans, buckets), counts(wanted, buckets))
    weighted = _weighted(scans, gain, scans.schema["doc_id"].dataType.simpleString())
    scored = weighted.withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumn("row", F.monotonically_increasing_id())
    return ranked(keep(scored, "scored"), least_words, percent).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
