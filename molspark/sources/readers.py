"""Scans of molecule tables, line files, record files and saved artifacts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

LABELED = T.StructType([T.StructField("smiles", T.StringType()), T.StructField("property", T.DoubleType())])
UNLABELED = T.StructType([T.StructField("smiles", T.StringType())])

# Artifact name parts that carry fold and run.
MODEL_NAME = r"_Model_Fold_([0-9]+)_Run_([0-9]+)\."
OUTPUT_SCALER, EXTRA_SCALER = "Outputs", "Extra"


# How tables are written and read back: strings as they are, quotes doubled inside quotes.
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_table(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """The columns of ``schema`` from CSV, found by their names in the header; others are ignored.

    A missing column, a row of another length, a malformed number and an empty table
    are errors. With ``multi_line`` values may hold line breaks; without it a large
    file is split over tasks.
    """
    raw = spark.read.csv(path, multiLine=multi_line, mode="FAILFAST", **CSV_OPTIONS)
    df = raw.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def read_labeled(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, LABELED)


def read_unlabeled(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, UNLABELED)


def read_smi(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``string name``; the name may be missing or hold blanks."""
    parts = F.split("value", r"\s+", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(
        parts[0].alias("smiles"), F.get(parts, F.lit(1)).alias("name")
    )


def read_sdf(spark: SparkSession, path: str, tags: Sequence[str]) -> DataFrame:
    """Records ended by ``$$$$``: title line and the whole value under each ``> <tag>``.

    A value runs to the next blank line or tag and may have several lines. Files with
    carriage returns are recognised by their first line.
    """
    first = spark.read.text(path, lineSep="\n").first()
    end = "\r\n" if first is not None and first[0].endswith("\r") else "\n"
    records = spark.read.text(path, lineSep=f"$$$${end}").where(F.trim("value") != "")
    records = records.select(F.replace("value", F.lit(end), F.lit("\n")).alias("value"))

    def tagged(tag):
        header = rf"(?:^|\n)> *<{re.escape(tag)}>[^\n]*(?:\n|$)"
        lines = F.regexp_extract("value", header + r"((?:(?!> *<)[^\n]+(?:\n|$))*)", 1)
        return F.when(F.col("value").rlike(header), F.regexp_replace(lines, r"\n\z", ""))

    return records.select(
        F.substring_index("value", "\n", 1).alias("name"), *[tagged(t).alias(t) for t in tags]
    )


def read_saved(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A saved Parquet artifact, or None when it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def artifact_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Names of all files below a folder; contents stay unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")


def manifest(paths: DataFrame) -> DataFrame:
    """Folds, runs and scaler presence read from artifact names."""
    name = F.substring_index("path", "/", -1)
    fold = F.nullif(F.regexp_extract(name, MODEL_NAME, 1), F.lit("")).cast("int")
    run = F.nullif(F.regexp_extract(name, MODEL_NAME, 2), F.lit("")).cast("int")
    scaler = lambda kind: name.contains("Scaler") & name.contains(kind)
    return paths.select(fold.alias("fold"), run.alias("run"), scaler(OUTPUT_SCALER).alias("o"), scaler(EXTRA_SCALER).alias("e")).agg(
        F.count_distinct(F.when(F.col("run") == 0, F.col("fold"))).alias("n_folds"),
        F.count_distinct(F.when(F.col("fold") == 0, F.col("run"))).alias("n_runs"),
        F.coalesce(F.bool_or("o"), F.lit(False)).alias("scale_output"),
        F.coalesce(F.bool_or("e"), F.lit(False)).alias("has_extra"),
    )
