"""A versioned store of chunks with a manifest: incremental updates, stale rows, tombstones, top-k search.

Under one folder: ``chunks/v=N`` and ``changes/v=N``, written by commit N, and
``manifest/v=N``, one row, written last. Only commits with a manifest count, so a
commit that was cut off leaves nothing to see and is written anew. A change row tells
of a document whether it was put (with the digest of its text) or taken away; the last
one counts, and chunks of earlier versions are stale. The same settings, listed in
the manifest, must have made all versions; other settings begin a new store under
the next version and the older ones are no longer read.

Defined cases: null and blank texts are known but have no chunks; of rows that repeat
an id, the one of the greatest text counts; rows without an id are left out; an
update by an empty table takes every document away; ties in a search go to the
smaller id and chunk.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import retrieval

VERSION = 2


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, size: int = 1400, overlap: int = 180, least: int = 80, collection: str = "papers"):
        self.spark, self.path, self.cut = spark, path.rstrip("/"), (size, overlap, least)
        self.settings = json.dumps({"version": VERSION, "size": size, "overlap": overlap, "least": least, "collection": collection}, sort_keys=True)

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def manifests(self) -> list[dict]:
        """The commits, in order; a row each."""
        if not self._exists(f"{self.path}/manifest"):
            return []
        rows = self.spark.read.schema("settings string, base int, put long, gone long, v int").json(f"{self.path}/manifest").orderBy("v").collect()
        return [r.asDict() for r in rows]

    def _base(self, commits: list[dict]) -> tuple[int, int]:
        """The first version that still counts, and the next one to write."""
        if not commits:
            return 0, 0
        last = commits[-1]
        return (last["base"] if last["settings"] == self.settings else last["v"] + 1), last["v"] + 1

    def _read(self, name: str, schema: str, base: int, until: int) -> DataFrame:
        paths = [f"{self.path}/{name}/v={k}" for k in range(base, until)]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, v int")
        return self.spark.read.schema(f"{schema}, v int").option("basePath", f"{self.path}/{name}").parquet(*paths)

    def state(self) -> DataFrame:
        """doc_id, sha and v of the documents that the store holds."""
        base, until = self._base(self.manifests())
        changes = self._read("changes", "doc_id long, sha string", base, until)
        last = changes.groupBy("doc_id").agg(F.max_by("sha", "v").alias("sha"), F.max("v").alias("v"))
        return last.filter("sha IS NOT NULL")

    def chunks(self) -> DataFrame:
        """doc_id, chunk and chunk_text, of the current version of each document."""
        base, until = self._base(self.manifests())
        every = self._read("chunks", "doc_id long, chunk int, chunk_text string", base, until)
        return every.join(self.state().select("doc_id", "v"), ["doc_id", "v"]).select("doc_id", "chunk", "chunk_text")

    def update(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
        """Make the store hold ``docs``; only new and changed documents are cut, missing ones get a tombstone."""
        commits = self.manifests()
        base, v = self._base(commits)
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        now = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(text).alias("text")).withColumn("new", F.sha2("text", 256))
        had = self.state().select("doc_id", "sha")
        compared = now.select("doc_id", "new").join(had, "doc_id", "full").filter(~F.col("new").eqNullSafe(F.col("sha")))
        changes = f"{self.path}/changes/v={v}"
        compared.select("doc_id", F.col("new").alias("sha")).write.mode("overwrite").parquet(changes)
        put = self.spark.read.schema("doc_id long, sha string").parquet(changes)
        fresh = now.join(put.filter("sha IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
        retrieval.chunks(fresh, "doc_id", "text", *self.cut).select("doc_id", F.col("chunk").cast("int").alias("chunk"), "chunk_text").write.mode("overwrite").parquet(f"{self.path}/chunks/v={v}")
        counts = put.agg(F.count("sha").alias("put"), F.count_if(F.col("sha").isNull()).alias("gone"))
        counts.select(F.lit(self.settings).alias("settings"), F.lit(base).alias("base"), "put", "gone").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/v={v}")
        return counts.first().asDict() | {"v": v}

    def search(self, words: list[str], top_k: int) -> DataFrame:
        """The chunks with most of the words (at least one), ``top_k`` of them, and of each document its best."""
        low = F.lower("chunk_text")
        score = sum((F.when(F.contains(low, F.lit(w.lower())), 1).otherwise(0) for w in dict.fromkeys(words)), F.lit(0))
        best = self.chunks().withColumn("score", score).filter("score > 0").groupBy("doc_id").agg(F.max("score").alias("score"), F.min_by("chunk", F.struct(-F.col("score"), "chunk")).alias("chunk"))
        return best.orderBy(F.desc("score"), "doc_id").limit(top_k)
