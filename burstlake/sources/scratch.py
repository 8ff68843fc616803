"""The folder for intermediate tables and streaming checkpoints: shared by driver and executors, deleted at the end."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_live: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, a temporary folder serves a session in one process and a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="burstlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/burstlake/{name}-{uuid.uuid4().hex}"
    _live.add(path)
    return path


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written to the shared folder and read again, so that its lineage ends there; a folder for each value of ``by``."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Delete what this process wrote; it runs by itself when the driver ends with its session still open."""
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        for path in sorted(_live):
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
            _live.discard(path)


atexit.register(clear)
