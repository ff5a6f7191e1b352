"""Best-fit packing of token ids into sequences of a fixed length.

Documents are encoded and cut where Spark holds them; only the counts of
pieces by length, at most one per length up to the sequence length, reach the
driver. There each sequence is filled greedily with the longest piece that
fits, then its smallest piece is replaced by two unpacked ones that fill the
widened gap more tightly, as long as that helps. A filling is used as often as
the counts allow, so there are few fillings however many documents there are.
Pieces learn their place from their rank among the pieces of their length;
ranks are dealt in salted groups, so no length meets in one task.

Defined cases: a null text counts as empty and an empty text is the separator
alone; a repeated row is packed as often as it occurs; ties of length are
placed in order of salt, id and piece; an empty table gives an empty table;
other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.bpe import word_bpe
from vellum.llm.scratch import keep

SEQUENCE = 2048
SEPARATOR = 0


def pieces(docs: DataFrame, path: str, length: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and separator, cut: doc_id, piece, start, length, ids_crc32."""
    named = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    id_type = named.schema["doc_id"].dataType.simpleString()
    end = np.array([SEPARATOR], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            rows, at = [], []
            for k, ids in enumerate(bpe.ids_of_batch(batch.column("text").to_pylist())):
                ids += end
                for n, c in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[c : c + 4 * length]
                    rows.append((n, c // 4, len(part) // 4, zlib.crc32(part)))
                    at.append(k)
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(columns[0], pa.int32())]
                + [pa.array(c, pa.int64()) for c in columns[1:]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return named.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def _filling(left: np.ndarray, size: int) -> Counter:
    """One sequence's lengths, from the counts ``left`` by length."""
    free = left.copy()
    bin_: Counter = Counter()
    gap = size
    while gap > 0:
        fits = np.flatnonzero(free[: gap + 1])
        if not len(fits):
            break
        longest = int(fits[-1])
        n = min(int(free[longest]), gap // longest)
        bin_[longest] += n
        free[longest] -= n
        gap -= n * longest
    while gap > 0 and len(bin_):
        smallest = min(bin_)
        pair = _two_for(free, smallest, gap + smallest)
        if pair is None:
            break
        bin_[smallest] -= 1
        if not bin_[smallest]:
            del bin_[smallest]
        free[smallest] += 1
        for x in pair:
            bin_[x] += 1
            free[x] -= 1
        gap += smallest - sum(pair)
    return bin_


def _two_for(free: np.ndarray, smallest: int, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum above ``smallest`` and within ``room``."""
    have = np.flatnonzero(free[: room + 1])
    if not len(have):
        return None
    # for each first length, the longest second one that still fits
    at = np.searchsorted(have, room - have, side="right") - 1
    second = np.where(at >= 0, have[np.maximum(at, 0)], -1)
    again = (second == have) & (free[have] < 2)
    second = np.where(again, np.where(at >= 1, have[np.maximum(at - 1, 0)], -1), second)
    total = np.where(second > 0, have + second, -1)
    best = int(total.argmax())
    return (int(have[best]), int(second[best])) if total[best] > smallest else None


def plan(counts: dict[int, int], size: int = SEQUENCE) -> pd.DataFrame:
    """Places by rank: of each ``length``, ranks from ``rank`` on, ``n`` of them, go to
    offset ``offset`` of the sequences from ``sequence`` on."""
    left = np.zeros(size + 1, dtype=np.int64)
    for k, n in counts.items():
        left[k] = n
    used = np.zeros(size + 1, dtype=np.int64)
    rows, sequence = [], 0
    while left.any():
        bin_ = _filling(left, size)
        times = min(int(left[k]) // m for k, m in bin_.items())
        offset = 0
        for k in sorted(bin_, reverse=True):
            for _ in range(bin_[k]):
                rows.append((k, int(used[k]), times, sequence, offset))
                used[k] += times
                offset += k
            left[k] -= bin_[k] * times
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "n", "sequence", "offset"]).sort_values(["length", "rank"])


def ranked(parts: DataFrame) -> DataFrame:
    """``parts`` with ``rank`` from 0 among those of the same length."""
    salts = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        salted.groupBy("length", "salt")
        .count()
        .select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    return (
        salted.withColumn("rank", F.row_number().over(within) - 1)
        .join(bases, ["length", "salt"])
        .withColumn("rank", F.col("rank") + F.col("base"))
        .drop("salt", "base")
    )


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its ``sequence_id`` and its gapless ``offset`` there."""
    parts = keep(pieces(docs, path, size, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most ``size`` rows
    places = plan(counts, size)
    key = (places["length"] * (1 << 40) + places["rank"]).to_numpy(np.int64)
    rank, sequence, offset = (places[c].to_numpy(np.int64) for c in ("rank", "sequence", "offset"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, nth: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(key, length.to_numpy() * (1 << 40) + nth.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + nth.to_numpy() - rank[at], "offset": offset[at]})

    placed = ranked(parts).withColumn("place", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
