"""Cutting lineage through tables in the shared folder named by ``spark.checkpoint.dir``.

A staged table survives the loss of any executor: it lies in the folder every executor shares, not in an executor's cache.
Only where the session names no such folder (tests, one machine) is a folder of our own made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_STAGED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from the session's settings."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN.append(tempfile.mkdtemp(prefix="tapeloom-"))
    return _OWN[0]


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written: same rows, short lineage, prunable columns.

    The table is removed when the driver ends, or by ``release`` once nothing that was made of it is needed any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, system = _file_system(spark, path)
    system.deleteOnExit(where)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove all tables that this application has staged, and say how many. DataFrames made of them can't be run afterwards."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where, system = _file_system(spark, path)
        system.delete(where, True)
    return len(paths)
