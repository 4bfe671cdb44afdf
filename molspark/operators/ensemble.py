"""Ensemble scoring: variants x members, unscale, mean and sigma per source row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from molspark.operators.scaling import inverse_transform


def expand_members(df: DataFrame, folds: int, runs: int) -> DataFrame:
    """Repeat every row for each (fold, run) member inside its own task."""
    members = F.array(*[
        F.struct(F.lit(f).alias("fold"), F.lit(r).alias("run")) for f in range(folds) for r in range(runs)
    ])
    return df.select("*", F.explode(members).alias("_m")).select("*", "_m.fold", "_m.run").drop("_m")


def score_expression(df: DataFrame, score: Column, out: str = "pred") -> DataFrame:
    """Score with a column expression over the row and ``fold``, ``run``."""
    return df.withColumn(out, score)


def score_batches(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], out: str = "pred") -> DataFrame:
    """Score Arrow batches with a Python callable: a frame in, one float per row out."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: scorer(batch).astype("float64")})

    return df.mapInPandas(run, schema)


def mean_sigma(preds: DataFrame, key: str | Sequence[str] = "src_id", pred: str = "pred") -> DataFrame:
    """Mean and population deviation over variants and members."""
    keys = [key] if isinstance(key, str) else list(key)
    return preds.groupBy(*keys).agg(F.avg(pred).alias("mean"), F.stddev_pop(pred).alias("sigma"))


def infer(
    variants: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    folds: int,
    runs: int,
    scaler: DataFrame | None = None,
    key: str = "src_id",
) -> DataFrame:
    """Exploded variants to ``key, mean, sigma``; unscaled per fold when asked."""
    preds = score(expand_members(variants, folds, runs))
    if scaler is not None:
        preds = inverse_transform(preds, scaler, "pred", "pred")
    return mean_sigma(preds, key)


def attach(base: DataFrame, preds: DataFrame, key: str = "src_id") -> DataFrame:
    """Predictions next to their inputs; rows without one keep nulls."""
    return base.join(preds, key, "left")


def write_back(base: DataFrame, fold_preds: DataFrame, key: str = "row_id") -> DataFrame:
    """Out-of-fold means and sigmas, and their fold if there is one, onto the base table by row key."""
    columns = [c for c in ("fold", "mean", "sigma") if c in fold_preds.columns]
    return base.join(fold_preds.select(key, *columns), key, "left")
