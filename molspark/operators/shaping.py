"""Column naming and assembly of input tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def unnest(df: DataFrame, keep: Sequence[str | Column], values: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per array entry next to ``keep``; empty and null arrays give none.

    The outer form plus a test on the position spares the optimizer's extra
    "array is not empty" filter, which would evaluate ``values`` again before it.
    """
    rows = df.select(*keep, F.posexplode_outer(values).alias(pos or "_pos", name))
    rows = rows.where(F.col(pos or "_pos").isNotNull())
    return rows if pos else rows.drop("_pos")


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the key columns appear once.

    A plain join on a nullable key drops its null rows, which would lose rows of
    every "aggregate, then join back" step.
    """
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return left.join(other, same, how).drop(*(f"_r_{k}" for k in keys))


def fill_strings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing strings become empty."""
    return df.na.fill("", list(columns))


def assemble(
    df: DataFrame,
    strings: Sequence[str],
    label: str,
    errors: Sequence[str] = (),
    extras: Sequence[str] = (),
    label_name: str | None = None,
) -> DataFrame:
    """One table with normalised headers: ``SMILES`` or ``SMILES_1..n``, the
    label, error columns named by their number, extras under their own names."""
    names = ["SMILES"] if len(strings) == 1 else [f"SMILES_{i + 1}" for i in range(len(strings))]
    error_names = {0: [], 1: ["Standard deviation"], 2: ["Minimum", "Maximum"]}[len(errors)]
    return df.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in zip(strings, names)],
        F.col(label).alias(label_name or label),
        *[F.col(c).alias(n) for c, n in zip(errors, error_names)],
        *extras,
    )
