"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it is counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 500_000


def scratch_dir(spark: SparkSession) -> str:
    """What the cluster names in ``spark.checkpoint.dir``; only where that is unset and all runs in one process (tests) a
    temporary folder is made, and used for the rest of the session."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("terradelta.scratch.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="terradelta-")
        spark.conf.set("terradelta.scratch.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """An unused path in the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written to the shared folder and read again: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Frees what steps that are over left in the driver: their broadcasts and shuffle files go, and its heap shrinks, only
    when its JVM collects garbage, which it puts off while there is room."""
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
