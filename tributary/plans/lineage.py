"""Reliable checkpoints for loops over DataFrames."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> None:
    """Leave spark.checkpoint.dir as it is; on one machine, where none is set (tests), set a temporary folder."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tributary-"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    checkpoint_dir(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


#: Splits of a table below which it is small enough to be dealt anew: four gigabytes at Spark's usual size of a split.
FEW_SPLITS = 32


def spread(scan: DataFrame) -> DataFrame:
    """A table just read, dealt to all cores where its files make fewer splits than there are; larger tables stay as they are."""
    cores = min(scan.sparkSession.sparkContext.defaultParallelism, FEW_SPLITS)
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def cut(df: DataFrame) -> DataFrame:
    """df computed once, in the shared checkpoint folder: plans of later rounds start from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
