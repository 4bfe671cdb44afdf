"""Sinks: artifacts that are reused once saved, iteration dumps, CSV and TSV."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from molspark.sources.readers import CSV_OPTIONS, read_saved

VOCABULARY_SCHEMA = "token string, token_id int"


def reuse_or_save(spark: SparkSession, path: str, schema: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The saved table when the path exists, otherwise ``build()`` saved there."""
    saved = read_saved(spark, path, schema)
    if saved is None:
        build().write.parquet(path)
        saved = read_saved(spark, path, schema)
    return saved


def saved_vocabulary(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    return reuse_or_save(spark, path, VOCABULARY_SCHEMA, build)


def saved_scaler(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Scaler rows ``fold, center, scale``; a saved one is used unchanged."""
    return reuse_or_save(spark, path, "fold int, center double, scale double", build)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; blanks, quotes, backslashes and line breaks in strings are kept."""
    df.write.csv(path, **CSV_OPTIONS)


def dump_iteration(selected: DataFrame, labeled: DataFrame, folder: str, iteration: int) -> None:
    """Selected rows and the grown labeled table of one iteration."""
    write_csv(selected, f"{folder}/selected/iter={iteration}")
    write_csv(labeled, f"{folder}/labeled/iter={iteration}")


def write_ranked(df: DataFrame, path: str, value: str = "property") -> None:
    """Final list by descending value; part files follow the order. The other
    columns break ties, which also lets a frequent value span several files."""
    rest = [c for c in df.columns if c != value]
    write_csv(df.orderBy(F.col(value).desc(), *rest), path)


def write_score_report(df: DataFrame, path: str) -> None:
    """TSV ``smiles, Name, sa_score`` with six decimals; null molecules skipped."""
    df.where(F.col("smiles").isNotNull()).select(
        "smiles",
        F.col("name").alias("Name"),
        F.when(F.col("sa_score").isNull(), "None").otherwise(F.format_string("%.6f", "sa_score")).alias("sa_score"),
    ).write.csv(path, sep="\t", header=True)
