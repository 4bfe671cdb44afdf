"""Intake until a number of new strings is reached, with counts and a memory that ends.

Every batch of the stream writes its new strings and its counts under its own number,
so a batch that is repeated after a failure replaces itself, and a restarted intake
goes on with what is there. Which strings were seen is read from the written batches;
with a time limit only from those that are recent enough, so what a batch is compared
with does not grow for ever.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import StreamingQueryException

from molspark.functions.validity import is_neutral, is_valid
from molspark.sources.readers import read_saved
from molspark.staging import stage

COUNTS = "attempts bigint, valid bigint, kept bigint, unique bigint, first timestamp, last timestamp, batch bigint"
_MET = "the target of the intake is met"


def accepted_within(stream: DataFrame, time: str, limit: str, text: str = "smiles", ionic: str = "all") -> DataFrame:
    """Valid, neutral strings, none passed on twice within ``limit`` of event time.

    The state keeps a digest per string until the watermark, which follows a batch
    behind, has passed its time by the limit; copies after that are new again. Rows
    without a time are dropped.
    """
    good = stream.where(F.col(time).isNotNull()).where(is_valid(F.col(text)) & is_neutral(F.col(text), ionic))
    seen = good.select(text, time, F.unhex(F.md5(text)).alias("_digest")).withWatermark(time, limit)
    return seen.dropDuplicatesWithinWatermark(["_digest"]).select(text, time)


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per written batch."""
    found = read_saved(spark, f"{folder}/counts", COUNTS)
    return spark.createDataFrame([], COUNTS) if found is None else found


def accepted(spark: SparkSession, folder: str, text: str = "smiles") -> DataFrame:
    """The strings accepted so far, with the batch that brought them."""
    schema = f"`{text}` string, batch bigint"
    found = read_saved(spark, f"{folder}/accepted", schema)
    return spark.createDataFrame([], schema) if found is None else found


def acceptance(spark: SparkSession, folder: str, target: int) -> DataFrame:
    """The counts of ``selection.acceptance`` over all batches so far."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    sums = counts(spark, folder).agg(*(total(c) for c in ("attempts", "valid", "kept", "unique")))
    done = F.least(F.col("unique"), F.lit(target).cast("bigint"))
    return sums.select(
        "attempts", "valid", "kept", (F.col("kept") - F.col("unique")).alias("duplicates"), done.alias("accepted"),
        (F.lit(target).cast("bigint") - done).alias("shortfall"),
    )


def take_batch(batch: DataFrame, number: int, folder: str, text: str = "smiles", ionic: str = "all", time: str | None = None, limit: str | None = None) -> None:
    """Writes the new strings of a batch and its counts.

    Strings are compared with the batches before this one; with ``time`` and ``limit``
    with those whose rows are at most ``limit`` older than this batch's oldest row.
    """
    spark = batch.sparkSession
    at: Column = F.lit(None).cast("timestamp") if time is None else F.col(time)
    kept = is_valid(F.col(text)) & is_neutral(F.col(text), ionic)
    per = batch.groupBy(text).agg(F.count(F.lit(1)).alias("c"), F.min(at).alias("first"), F.max(at).alias("last"))
    per = stage(per.select("*", F.coalesce(is_valid(F.col(text)), F.lit(False)).alias("v"), F.coalesce(kept, F.lit(False)).alias("k")), "batch")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0)).cast("bigint")
    row = per.agg(total(F.lit(True)).alias("a"), total(F.col("v")).alias("v"), total(F.col("k")).alias("k"), F.min("first").alias("f"), F.max("last").alias("l")).first()
    before = counts(spark, folder).where(F.col("batch") < number)
    if limit is not None and row.f is not None:
        before = before.where(F.col("last") >= F.lit(row.f) - F.expr(f"INTERVAL {limit}"))
    recent = [r.batch for r in before.select("batch").collect()]  # one number per batch
    known = accepted(spark, folder, text).where(F.col("batch").isin(recent))
    fresh = per.where("k").join(known.select(text), text, "left_anti").select(text)
    fresh.write.mode("overwrite").parquet(f"{folder}/accepted/batch={number}")
    unique = spark.read.schema(f"`{text}` string").parquet(f"{folder}/accepted/batch={number}").count()
    done = spark.createDataFrame([(row.a, row.v, row.k, unique, row.f, row.l)], COUNTS.removesuffix(", batch bigint"))
    done.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")


def run_until(stream: DataFrame, folder: str, target: int, text: str = "smiles", ionic: str = "all", time: str | None = None, limit: str | None = None) -> bool:
    """Takes batches until ``target`` strings are accepted or no rows are left; True if the target is met.

    A batch that arrives after the target is met is not taken: it stays uncommitted,
    and a later call with a higher target begins with it.
    """
    spark = stream.sparkSession
    reached = lambda: counts(spark, folder).agg(F.coalesce(F.sum("unique"), F.lit(0))).first()[0] >= target

    def hook(batch: DataFrame, number: int) -> None:
        earlier = counts(spark, folder).where(F.col("batch") != number).agg(F.coalesce(F.sum("unique"), F.lit(0))).first()[0]
        if earlier >= target:
            raise RuntimeError(_MET)
        take_batch(batch, number, folder, text, ionic, time, limit)

    if reached():
        return True
    query = stream.writeStream.foreachBatch(hook).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as error:
        if _MET not in str(error):
            raise
    return reached()
