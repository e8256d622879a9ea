"""Folders, versions and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Take the shared folder the cluster names; only a local session gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="mapwright-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows over all shuffle partitions ahead of heavy Python work.

    A fixed number keeps small inputs from being merged into one task; on a cluster it is
    the configured number of shuffle partitions.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, reachable by every executor."""
    return f"{use_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, with a short lineage."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def publish(df: DataFrame, base: str, version: int) -> None:
    """Write a new version, then point readers to it.

    Nothing is overwritten: the data go to their own folder first, and the pointer is a
    one-row append that happens only after that write has been committed.
    """
    df.write.mode("errorifexists").parquet(f"{base}/version={version}")
    point_to(df.sparkSession, base, version)


def point_to(spark: SparkSession, base: str, version: int) -> None:
    """Make a written version the current one; an older version restores it."""
    row = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"), F.lit(uuid.uuid1().time).alias("tick"))
    row.write.mode("append").parquet(f"{base}/pointer")


def current_version(spark: SparkSession, base: str) -> int:
    pointer = spark.read.parquet(f"{base}/pointer")
    return pointer.agg(F.max_by("version", "tick")).first()[0]


def read_current(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/version={current_version(spark, base)}")
