"""Robust and min-max scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from molspark.operators.rank import order_statistics
from molspark.operators.shaping import match_keys


def fit_robust(train: DataFrame, value: str, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """``center`` (median) and ``scale`` (p95 - p5, 1 when zero) per key."""
    stats = order_statistics(train, value, {"p05": 0.05, "p50": 0.5, "p95": 0.95}, keys)
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("stat")))
    spread = F.col("_hi") - F.col("_lo")
    return (
        stats.groupBy(*keys)
        .agg(pick("p50").alias("center"), pick("p05").alias("_lo"), pick("p95").alias("_hi"))
        .select(*keys, "center", F.when(spread == 0, 1.0).otherwise(spread).alias("scale"))
    )


def fit_robust_columns(train: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("fold",)) -> DataFrame:
    """``keys, column, center, scale`` of many columns at once, by the scans that one column takes.

    Each row's values become an array of (column, value) pairs next to the scan; the
    sketches, brackets and counts of all columns are aggregated together. Nulls take no
    part; a column without values has no row.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("_v")) for c in columns))
    long = train.select(*keys, F.explode(pairs).alias("_e")).select(*keys, "_e.*").where("_v IS NOT NULL")
    return fit_robust(long, "_v", [*keys, "column"])


def transform(df: DataFrame, scaler: DataFrame, value: str, out: str, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Scale by the row's fold; null where its fold has no scaler row. A saved
    scaler is a tiny table, which Spark broadcasts by its size."""
    return match_keys(df, scaler, list(keys), "left").withColumn(
        out, (F.col(value) - F.col("center")) / F.col("scale")
    ).drop("center", "scale")


def inverse_transform(df: DataFrame, scaler: DataFrame, value: str, out: str, keys: Sequence[str] = ("fold",)) -> DataFrame:
    return match_keys(df, scaler, list(keys), "left").withColumn(
        out, F.col(value) * F.col("scale") + F.col("center")
    ).drop("center", "scale")


def min_max(df: DataFrame, value: str, out: str, keys: Sequence[str]) -> DataFrame:
    """Normalise to [0, 1] per key; a constant key gives 0.

    Extremes are aggregated before the join, so a large key is not sorted or
    gathered in one task.
    """
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    span = F.col("_max") - F.col("_min")
    return match_keys(df, ends, keys).withColumn(
        out, F.when(span == 0, 0.0).otherwise((F.col(value) - F.col("_min")) / span)
    ).drop("_min", "_max")
