"""Syntactic checks of molecule strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from molspark.functions.tokens import STRICT_TOKEN_PATTERN

# Characters that mark an ionic or multi-part string, per mode.
IONIC_PATTERNS = {"all": r"[.\-+]", "+": r"[.+]", "-": r"[.\-]"}
_BRACKET = r"\[[^\[\]]*\]"


def covered(text: Column) -> Column:
    """Every character belongs to a token and the string is not empty."""
    return (text != "") & (F.regexp_replace(text, STRICT_TOKEN_PATTERN, "") == "")


def parentheses_balanced(text: Column) -> Column:
    """Depth never negative and zero at the end; -1 absorbs a failure."""
    marks = F.split(F.regexp_replace(text, r"[^()]", ""), "")
    depth = F.aggregate(
        marks,
        F.lit(0),
        lambda d, ch: F.when(d < 0, d).when(ch == "(", d + 1).when(ch == ")", d - 1).otherwise(d),
    )
    return depth == 0


def brackets_balanced(text: Column) -> Column:
    return ~F.regexp_replace(text, _BRACKET, "").rlike(r"[\[\]]")


def rings_paired(text: Column) -> Column:
    """Each ring label outside brackets occurs an even number of times."""
    labels = F.regexp_extract_all(
        F.regexp_replace(text, _BRACKET, ""), F.lit(r"(%[0-9]{2}|[0-9])"), F.lit(1)
    )
    odd = F.aggregate(
        labels,
        F.array().cast("array<string>"),
        lambda open_, lab: F.when(
            F.array_contains(open_, lab), F.array_remove(open_, lab)
        ).otherwise(F.array_append(open_, lab)),
    )
    return F.size(odd) == 0


def is_valid(text: Column) -> Column:
    """All checks, cheapest and most selective first."""
    text = F.trim(text)
    return F.coalesce(
        F.when(~covered(text), False)
        .when(~brackets_balanced(text), False)
        .when(~parentheses_balanced(text), False)
        .otherwise(rings_paired(text)),
        F.lit(False),
    )


def is_neutral(text: Column, mode: str = "all") -> Column:
    """Keep test of the ionic filter; an unknown mode keeps everything."""
    pattern = IONIC_PATTERNS.get(mode)
    return F.lit(True) if pattern is None else ~text.rlike(pattern)
