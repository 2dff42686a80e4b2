"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where that is unset and all runs on this machine (tests), one temporary folder a process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-wardline-", dir="/tmp")
    return _own["dir"]


def unclustered(name: str) -> Column:
    """A long column under its own name whose partitioning the optimiser can't see.

    A join on an aggregate's key otherwise reuses the aggregate's shuffle, and adaptive execution only splits a hot
    key's partition if both sides of the join end in a shuffle of their own.
    """
    return F.shiftleft(name, 0).alias(name)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/wardline/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later plans start from the files."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a folder written by this module through Hadoop's file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
