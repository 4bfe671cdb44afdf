"""Tables written to the cluster's shared folder between steps.

A staged table survives the loss of any executor, cuts the lineage of loops and
gives every later branch the same rows in the same partitions.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a fresh one only in local mode."""
    path = spark.conf.get(_CONF, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CONF} to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="molspark-", dir="/tmp")
    spark.conf.set(_CONF, path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_checked(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast hint when the table has at most ``limit`` rows, else unchanged.

    Meant for staged or source tables, since it counts up to ``limit`` rows.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Redistribute rows when a table comes in fewer splits than there are cores.

    Meant before heavy per-row work on a small or badly split file; a table with
    enough splits is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
