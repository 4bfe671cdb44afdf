"""Candidate intake from arriving files, with stateful dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from molspark.operators.selection import keep_neutral, keep_valid
from molspark.staging import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def candidate_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """Files appearing in a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)


def accepted(stream: DataFrame, text: str = "smiles", ionic: str = "all") -> DataFrame:
    """Valid, neutral strings, each passed on once over the life of the stream.

    The state holds a 16-byte digest of every distinct string seen, which is what
    "never twice" means; filters come first and only the string column is kept.
    """
    kept = keep_neutral(keep_valid(stream, text), text, ionic)
    return kept.select(text, F.unhex(F.md5(text)).alias("_digest")).dropDuplicates(["_digest"]).select(text)


def drain(stream: DataFrame, out: str, state: str) -> None:
    """Process everything available, then stop; restarts continue from ``state``."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # state on disk instead of the executor heap
    try:
        query = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", state)
            .trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()


def intake(spark: SparkSession, folder: str, schema: T.StructType, text: str = "smiles", ionic: str = "all") -> DataFrame:
    """Drain a folder into the shared folder and return the accepted strings."""
    out, state = fresh_path(spark, "intake"), fresh_path(spark, "intake-state")
    drain(accepted(candidate_stream(spark, folder, schema), text, ionic), out, state)
    return spark.read.schema(T.StructType([T.StructField(text, T.StringType())])).parquet(out)
