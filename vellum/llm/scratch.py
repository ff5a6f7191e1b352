"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table and reading it back, so a lost executor costs
only the tasks that were running. The folder is the one in
``spark.checkpoint.dir``; where that is unset, as in tests, a local session makes one.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vellum.sources.session import local_folder

_LOCAL: list[str] = []

#: Clears what a module keeps in a Python worker from task to task; see :func:`unburden`.
HELD: list[Callable[[], None]] = []


def unburden() -> None:
    """Give back what earlier tasks of other operators left in this Python worker, which Spark uses again."""
    for clear in HELD:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the session's checkpoint folder."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not _LOCAL:
            _LOCAL.append(local_folder(spark.sparkContext.master))
        top = f"file://{_LOCAL[0]}"
    return f"{top.rstrip('/')}/vellum-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    _tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def keep_by(df: DataFrame, name: str, column: str) -> tuple[str, DataFrame]:
    """As :func:`keep`, in a folder for each value of ``column``; also the table's path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").partitionBy(column).parquet(path)
    _tidy(spark)
    return path, spark.read.schema(df.schema).parquet(path)


def _tidy(spark: SparkSession) -> None:
    """Let the driver's collector run, which is when Spark removes the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder, through the file system that its path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
