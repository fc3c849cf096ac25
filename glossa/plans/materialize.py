"""Lineage cuts that survive lost executors: Parquet in the folder the cluster shares.

What is written is deleted when the driver's process ends, after an error too; ``discard`` does so at once.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``.

    A local session (tests) may have none and gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir() + "/checkpoints"
    return f"{base.rstrip('/')}/glossa"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the process ends."""
    if not _WRITTEN:
        atexit.register(_clear)
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._glossa_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; later reads of it fail."""
    path = getattr(df, "_glossa_path", None)
    if path in _WRITTEN:
        _delete(_WRITTEN.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clear() -> None:
    for path, spark in list(_WRITTEN.items()):
        if spark.sparkContext._jsc is None:  # the session has ended; its cluster clears the folder
            return
        _delete(spark, path)
    _WRITTEN.clear()
