"""Tables on the way to a result, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the setting is absent and all of Spark runs in this process, a
    folder of this machine serves; on a cluster the setting must be there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="ledgerloom-"))


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as Hadoop has it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def hold(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: a result that later steps read twice must not be dealt out twice.

    The table outlives any executor. It stays until ``clear`` or the end of the process.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def clear() -> None:
    """Delete the tables made so far; frames made from them can't be read any more."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            if spark.sparkContext._jsc is not None:
                fs, where = filesystem(spark, path)
                fs.delete(where, True)
        except Exception:  # the session ended first; the cluster's own cleaner has the folder
            continue
