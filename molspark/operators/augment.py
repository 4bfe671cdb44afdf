"""Variant enumeration and the split of unusable rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from molspark.functions.tokens import all_rotations, body_tokens, bound
from molspark.operators.shaping import unnest


def rotation_variants(text: Column) -> Column:
    """Default variant provider: the string, then the rotations of its tokens."""
    return all_rotations(body_tokens(text))


def variant_provider(fn: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """Wrap a function of a Series of strings, such as a chemistry library call, as a column.

    It returns a list per string, whose first entry should be the canonical form; a
    None entry marks an unusable string. Null strings have no list.
    """
    @F.pandas_udf("array<string>")
    def provide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for strings in batches:
            known = strings.notna()
            yield fn(strings[known]).reindex(strings.index).where(known, None)

    return provide


def usable(variants: Column) -> Column:
    """False for rows without variants or with a null one."""
    return F.coalesce(
        (F.size(variants) > 0) & F.forall(variants, lambda v: v.isNotNull()), F.lit(False)
    )


def split_rejected(df: DataFrame, variants: str = "variants", require: bool = False) -> tuple[DataFrame, DataFrame]:
    """Usable rows and rejected rows; with ``require`` none usable is an error."""
    good = df.where(usable(F.col(variants)))
    if require and good.isEmpty():
        raise ValueError("no usable string in the input")
    return good, df.where(~usable(F.col(variants)))


def explode_variants(df: DataFrame, variants: str = "variants", name: str = "variant") -> DataFrame:
    """One row per variant with its number; other columns repeat."""
    other = [c for c in df.columns if c != variants]
    return unnest(df, other, F.col(variants), name, "variant_no")


def combine_variants(*variants: Column) -> Column:
    """All combinations of the variants of several strings of one row, the last
    string varying fastest; entries are arrays of strings."""
    combos = F.transform(variants[0], lambda v: F.array(v))
    for nxt in variants[1:]:
        combos = bound(nxt, partial(_product, combos))
    return combos


def _product(combos: Column, options: Column) -> Column:
    return F.flatten(
        F.transform(combos, lambda head: F.transform(options, lambda v: F.array_append(head, v)))
    )
