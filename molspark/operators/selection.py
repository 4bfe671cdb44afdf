"""Filters, unions and ranked selections of candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from molspark.functions.tokens import PAD_ID
from molspark.functions.validity import is_neutral, is_valid
from molspark.operators.rank import has_value, top_rows


def keep_valid(df: DataFrame, text: str = "smiles", plug_in: Column | None = None) -> DataFrame:
    """Syntactically valid strings; ``plug_in`` adds a further test such as a UDF."""
    kept = df.where(is_valid(F.col(text)))
    return kept if plug_in is None else kept.where(plug_in)


def keep_neutral(df: DataFrame, text: str = "smiles", mode: str = "all") -> DataFrame:
    return df.where(is_neutral(F.col(text), mode))


def keep_positive(df: DataFrame, prob: str = "property") -> DataFrame:
    return df.where(F.col(prob) > 0.5)


def top_fraction(df: DataFrame, value: str, unique_id: str, cutoff: float = 0.5) -> DataFrame:
    """The best ``ceil(n * cutoff)`` of the ``n`` rows that have a value, null and NaN aside, by descending value."""
    n = df.where(has_value(df, value)).count()
    return top_rows(df, value, unique_id, math.ceil(n * cutoff), n)


def top_and_bottom(df: DataFrame, value: str, unique_id: str, n_top: int, n_bottom: int) -> DataFrame:
    """Report rows from both ends with an ``end`` flag; short lists overlap, rows without a value are left out."""
    df = df.where(has_value(df, value))
    best = [F.col(value).desc(), F.col(unique_id).asc()]
    worst = [F.col(value).asc(), F.col(unique_id).desc()]
    top = df.orderBy(*best).limit(n_top).withColumn("end", F.lit("top"))
    bottom = df.orderBy(*worst).limit(n_bottom).withColumn("end", F.lit("bottom"))
    return top.unionByName(bottom)


def preview(df: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def all_strings(*frames: DataFrame, text: str = "smiles") -> DataFrame:
    """Strings of several tables one after another, duplicates kept."""
    out = frames[0].select(text)
    for f in frames[1:]:
        out = out.unionByName(f.select(text))
    return out


def append_rows(base: DataFrame, extra: DataFrame) -> DataFrame:
    return base.unionByName(extra.select(*base.columns))


def distinct_strings(df: DataFrame, text: str = "smiles") -> DataFrame:
    """One row per string."""
    return df.select(text).distinct()


def first_of_each(df: DataFrame, text: str, order: str) -> DataFrame:
    """One row per string with its lowest ``order``; partial minima go first."""
    return df.groupBy(text).agg(F.min(order).alias(order))


def acceptance(df: DataFrame, target: int, text: str = "smiles", mode: str = "all") -> DataFrame:
    """Counts of one generation pass: attempts, valid, kept by the ionic filter,
    duplicates among those, accepted up to the target, and what is missing."""
    per_string = df.groupBy(text).agg(F.count(F.lit(1)).alias("_c")).select(
        "_c",
        is_valid(F.col(text)).alias("_v"),
        (is_valid(F.col(text)) & is_neutral(F.col(text), mode)).alias("_k"),
    )
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_c"))), F.lit(0)).cast("bigint")
    counts = per_string.agg(
        total(F.lit(True)).alias("attempts"),
        total(F.col("_v")).alias("valid"),
        total(F.col("_k")).alias("kept"),
        F.count_if("_k").alias("unique"),
    )
    accepted = F.least(F.col("unique"), F.lit(target).cast("bigint"))
    return counts.select(
        "attempts", "valid", "kept", (F.col("kept") - F.col("unique")).alias("duplicates"),
        accepted.alias("accepted"), (F.lit(target).cast("bigint") - accepted).alias("shortfall"),
    )


def training_rows(df: DataFrame, ids: str = "ids") -> DataFrame:
    """``input_ids, attention_mask, labels`` padded to the longest row."""
    longest = df.agg(F.max(F.size(ids))).first()[0] or 0
    gap = F.lit(longest) - F.size(ids)
    padded = F.concat(F.col(ids), F.array_repeat(F.lit(PAD_ID), gap))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), gap))
    return df.withColumns({"input_ids": padded, "attention_mask": mask, "labels": padded})
