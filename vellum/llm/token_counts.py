"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A store is a folder of two tables, each a sub-folder per batch. ``counts`` logs
signed rows per document: an insert is +1 document and its tokens, a delete
takes back what the log holds, a revision is both. ``deltas`` has the same rows
summed by group, and the totals are their sum, so no total is ever recomputed
from texts. A batch is committed when its deltas are; committing it again
changes nothing, and a commit that broke off is simply written anew.

Defined cases: null source or language is a group of its own; null and empty
texts are documents of no tokens; of several rows of one id in a batch the
greatest (tokens, characters, source, language) counts, and a deletion of the id beats
insertions; inserting a present id revises it, deleting an absent one changes
nothing; null ids are one document; groups whose documents are all gone leave
the totals; an empty batch commits nothing but itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("source", "lang", "version")
COUNTS = "doc_id long, source string, lang string, version string, docs long, tokens long, chars long"
DELTAS = "source string, lang string, version string, docs long, tokens long, chars long"


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """The byte-level tokenizer of this worker."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, path: str, pattern: str, version: str) -> DataFrame:
    """A +1 row per document: doc_id, source, lang, version, docs, tokens, chars."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = pa.array([len(tool.encode_ordinary(t)) for t in texts], pa.int64())
            chars = pa.array(map(len, texts), pa.int64())
            one = pa.array([1] * len(texts), pa.int64())
            kept = [batch.column(c) for c in ("doc_id", "source", "lang")]
            names = ["doc_id", "source", "lang", "version", "docs", "tokens", "chars"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([version] * len(texts)), one, n, chars], names=names)

    return rows.mapInArrow(run, COUNTS)


class Rollup:
    """The store under ``path``, any folder that Spark reads and writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.path}/deltas/batch={batch}/_SUCCESS")

    def _batches(self) -> list[str]:
        """The committed batches' names."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/deltas")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(n.removeprefix("batch=") for n in names if self.committed(n.removeprefix("batch=")))

    def _table(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{name}/batch={b}" for b in self._batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def present(self, among: DataFrame | None = None) -> DataFrame:
        """What the log holds of each document, or of those with a ``t_id`` of ``among``."""
        sums = [F.sum(c).alias(c) for c in ("docs", "tokens", "chars")]
        log = self._table("counts", COUNTS)
        if among is not None:
            log = log.join(among.select("t_id").distinct(), F.col("doc_id").eqNullSafe(F.col("t_id")), "left_semi")
        return log.groupBy("doc_id", *GROUP).agg(*sums).filter("docs <> 0")

    def commit(self, batch: str, upserts: DataFrame | None = None, deleted: DataFrame | None = None) -> bool:
        """Apply counted rows (:func:`counted`) and deleted ids as one batch; False if it was committed before."""
        if self.committed(batch):
            return False
        empty = self.spark.createDataFrame([], COUNTS)
        gone = (deleted.select(F.col("doc_id").cast("long").alias("doc_id")) if deleted is not None else empty.select("doc_id")).distinct()
        new = upserts if upserts is not None else empty
        rest = [c for c in new.columns if c not in ("doc_id", "version")]
        new = new.groupBy("doc_id", "version").agg(F.max(F.struct("tokens", "chars", "source", "lang", "docs")).alias("r"))
        new = new.select("doc_id", "version", *[F.col(f"r.{c}").alias(c) for c in rest])
        new = new.join(gone.withColumnRenamed("doc_id", "g"), F.col("doc_id").eqNullSafe(F.col("g")), "left_anti")
        if self._batches():
            touched = new.select("doc_id", "version").unionByName(gone.withColumn("version", F.lit(None).cast("string")))
            touched = touched.toDF("t_id", "t_version").distinct()
            same = F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("t_version").isNull() | (F.col("version") == F.col("t_version")))
            back = self.present(touched).join(touched, same, "left_semi")
            back = back.withColumns({c: -F.col(c) for c in ("docs", "tokens", "chars")})
            new = new.unionByName(back)
        names = [f.split()[0] for f in COUNTS.split(", ")]
        counts = f"{self.path}/counts/batch={batch}"
        new.select(*names).write.mode("overwrite").option("compression", "zstd").parquet(counts)
        signed = self.spark.read.schema(COUNTS).parquet(counts)
        deltas = signed.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "chars")])
        deltas.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens, n_chars."""
        sums = [F.sum(c).alias(f"n_{c}") for c in ("docs", "tokens", "chars")]
        return self._table("deltas", DELTAS).groupBy(*GROUP).agg(*sums).filter("n_docs <> 0")
