"""Shared scratch storage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``). Only in local mode, where driver and
    executors are one machine, is one made and set where that is unset. What was written there is deleted by
    ``clean_up``, or when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="confluo-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not _made:
        atexit.register(clean_up)
    path = f"{base.rstrip('/')}/confluo-{uuid.uuid4().hex}-{tag}"
    _made.append((spark, path))
    return path


def clean_up() -> None:
    """Delete everything that ``scratch`` gave out; frames that read it can't be used any more."""
    while _made:
        spark, path = _made.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back, so that nothing before it runs again."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by ``by`` to at least three tasks a core, also where it is too small in bytes for Spark to split it: what follows
    costs far more than the bytes tell."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *by)
