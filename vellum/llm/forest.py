"""Nearest neighbours by a hash-prefix forest.

Rows are dealt into blocks of bounded size, queries into blocks of their own,
and each pair of blocks is searched apart. In a block every tree is a sorted
array of long bit strings, the sides of random hyperplanes through the block's
middle. A query descends each tree to its longest matching prefix; then all
trees ascend together, one bit at a time, until the distinct matches that differ
from the query make up ``SHARE`` of the block, and all of a block of up to
``SMALL``. Candidates are ranked by their exact distance, and the blocks' bests are merged.

Equal vectors are one entry of a block's forest, so many copies of a vector
crowd nobody out; of each entry the smallest ids are passed on, as many as a
result can hold.

Defined cases: vectors that are null, empty, all zero or hold a null or
non-finite component take no part, nor do null ids; a query is compared with
vectors of its own length only; ties go to the smaller id; rows that repeat an
id are one candidate, at its smallest distance; with fewer candidates than
``k`` all are returned; an empty table gives an empty table; other columns of
the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES = 64
BITS = 24
SHARE = 0.6
BLOCK = 2048
SMALL = 512
SEED = 7


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (array of doubles) of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        .filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
        .filter(F.exists(v, lambda x: x != 0))
    )


class Forest:
    """The sorted arrays of a block's distinct vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS):
        rng = np.random.default_rng(SEED)
        self.vectors, self.bits = vectors, bits
        self.planes = rng.standard_normal((vectors.shape[1], trees * bits))
        side = vectors @ self.planes
        self.middle = np.median(side, axis=0)
        self.codes = self._strings(side)
        self.order = np.argsort(self.codes, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.codes, self.order, axis=0)

    def _strings(self, side: np.ndarray) -> np.ndarray:
        """One bit string per vector and tree, as a number."""
        up = (side > self.middle).reshape(len(side), -1, self.bits)
        return up @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of each prefix length's matches, by (length, query, tree)."""
        codes = self._strings(queries @ self.planes)
        low = np.empty((self.bits + 1, *codes.shape), np.int64)
        high = np.empty_like(low)
        for length in range(self.bits + 1):
            free = (1 << (self.bits - length)) - 1
            for t in range(codes.shape[1]):
                low[length, :, t] = np.searchsorted(self.sorted[:, t], codes[:, t] & ~free, side="left")
                high[length, :, t] = np.searchsorted(self.sorted[:, t], codes[:, t] | free, side="right")
        return low, high

    def candidates(self, queries: np.ndarray, least: int):
        """For each query the places of its candidates: ``least`` distinct ones at least that differ from it, or all."""
        low, high = self.ranges(queries)
        total = (high - low).sum(axis=2)
        length = np.maximum((total >= least).sum(axis=0) - 1, 0)  # repeats count here, so no longer one can be enough
        for q in range(len(queries)):
            seen = (self.vectors == queries[q]).all(axis=1)
            wanted = least + int(seen.sum())
            for n in range(length[q], -1, -1):
                for t, (a, b) in enumerate(zip(low[n, q].tolist(), high[n, q].tolist())):
                    seen[self.order[a:b, t]] = True
                if seen.sum() >= wanted:
                    break
            yield np.flatnonzero(seen)


def _vectors(table: pa.Table) -> np.ndarray:
    flat = table.column("vector").combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search_block(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Each query's best ``k`` of a block."""
    if not len(rows) or not len(queries):
        return RESULT.empty_table()
    ids = rows.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    distinct, entry = np.unique(_vectors(rows)[order], axis=0, return_inverse=True)
    entry, ids = np.unique(np.stack([entry.reshape(-1), ids[order]]), axis=1)  # ids ascend within an entry
    first = np.searchsorted(entry, np.arange(len(distinct) + 1))
    forest = Forest(distinct)
    wanted, query_ids = _vectors(queries), queries.column("vec_id").to_numpy()
    out = []
    for q, found in enumerate(forest.candidates(wanted, len(distinct) if len(distinct) <= SMALL else max(k + 1, int(SHARE * len(distinct))))):
        score = np.sqrt(((distinct[found] - wanted[q]) ** 2).sum(axis=1))
        near = found[np.argsort(score, kind="stable")]
        score = np.sort(score, kind="stable")
        if len(score) > k + 1:  # all that tie with the last place stay
            keep = score <= score[k]
            near, score = near[keep], score[keep]
        best = []
        for e, s in zip(near.tolist(), score.tolist()):
            best += [(s, int(i)) for i in ids[first[e] : min(first[e + 1], first[e] + k + 1)]]
        seen = {int(query_ids[q])}
        for s, i in sorted(best):
            if i not in seen:
                seen.add(i)
                out.append((int(query_ids[q]), i, s))
            if len(seen) > k:
                break
    columns = list(zip(*out)) if out else [[], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, RESULT)], schema=RESULT)


def nearest(rows: DataFrame, k: int = 10, one_in: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``one_in``."""
    data = usable(rows, id_col, vector_col)
    n, n_queries = data.agg(F.count("*"), F.count(F.when(F.col("vec_id") % one_in == 0, 1))).first()
    blocks, query_blocks = -(-n // BLOCK) or 1, -(-n_queries // BLOCK) or 1
    size = F.size("vector").alias("size")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")
    own = F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).alias("query_block")
    every = lambda count, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias(name)
    dealt = data.select("vec_id", "vector", size, block, every(query_blocks, "query_block"))
    asked = data.filter(F.col("vec_id") % one_in == 0).dropDuplicates(["vec_id"])
    asked = asked.select("vec_id", "vector", size, own, every(blocks, "block"))
    keys = ["size", "block", "query_block"]
    found = (
        dealt.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInArrow(lambda left, right: search_block(left, right, k), "query_id long, vec_id long, score double")
    )
    nth = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nth)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
