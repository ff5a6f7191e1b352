"""Session settings that operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``; where it is unset, as in tests, one is made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or local_folder(sc.master))


def local_folder(master: str) -> str:
    """A new folder of this machine, which only a local session may use."""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="vellum-")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application, so that it need not be installed on every node."""
    import os
    import shutil

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    to = os.path.join(tempfile.mkdtemp(prefix="vellum-"), "vellum")
    sc.addPyFile(shutil.make_archive(to, "zip", root_dir=root, base_dir="vellum"))
