"""The folder that driver and executors share, and cutting lineage there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where that is unset and driver
    and executors are one process does a temporary folder take its place."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="sieveline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str = "sieveline") -> str:
    """A new path in the shared folder; what is written there goes when the
    driver ends."""
    home = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(home)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{home}/data"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost
    executor costs a read and never a recomputation from the start."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
