"""Folders for files that a query writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

#: What was given out and not deleted yet.
GIVEN: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; in a temporary one only where that is unset, as in local tests. It is
    deleted when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="prismatic-"))
        base = spark.sparkContext.getCheckpointDir()
    if not GIVEN:
        atexit.register(clear, spark)
    GIVEN.append(f"{base}/prismatic-files/{name}-{uuid.uuid4().hex}")
    return GIVEN[-1]


def clear(spark: SparkSession) -> None:
    sc = spark.sparkContext
    gone, GIVEN[:] = GIVEN[:], []
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    for p in gone:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
