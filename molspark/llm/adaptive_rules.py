"""Quality rules whose thresholds come from the corpus itself.

Each text gets statistics. Per language and source, a quantile sketch of each
statistic is built map-side and merged; merging the same sketches again gives those
of the language and of the whole corpus. A group's quartiles are blended with those
of its language, and these with the corpus's: the group's own weigh the more, the
more rows it has, so no verdict turns at one row more or less. Fences around the
quartiles become the thresholds, which are joined back to the statistics to filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from molspark.llm.text import per_text, small_batches, text_udf
from molspark.staging import broadcast_checked, stage

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
GROUP_ROWS = 200  # a group of so many rows weighs as much as the next wider one
SKETCH_SIZE = 400
THRESHOLD_ROWS = 20_000  # broadcast the thresholds up to so many groups


@dataclass(frozen=True)
class Rule:
    """A statistic and how far beyond its quartiles it may lie: ``reach`` quartile ranges, ``slack`` at least."""

    name: str
    value: str
    side: str  # low or high
    reach: float
    slack: float


#: The statistics are shares or logarithms, so that one slack fits all groups.
RULES = (
    Rule("few_words", "ln(n_words + 1)", "low", 3.0, 1.0),
    Rule("short_words", "ln(word_chars / n_words)", "low", 3.0, 0.3),
    Rule("long_words", "ln(word_chars / n_words)", "high", 3.0, 0.3),
    Rule("symbols", "n_symbols / n_words", "high", 3.0, 0.1),
    Rule("repeated_lines", "n_dup_lines / n_lines", "high", 3.0, 0.4),
    Rule("repeated_words", "n_repeat_words / n_words", "high", 3.0, 0.28),
    Rule("capitals", "n_capitals / word_chars", "high", 3.0, 0.1),
    Rule("digits", "n_digits / word_chars", "high", 3.0, 0.25),
    Rule("stutters", "n_stutters / n_words", "high", 3.0, 0.1),
)
_STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_stutters")


def _class(chars: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_SYMBOLS, _SPACE = _class(b"#*$%&|<>"), _class(b"\x20\x09\x0a\x0b\x0c\x0d")
_CAPITALS, _DIGITS, _LATER = _class(range(65, 91)), _class(range(48, 58)), _class(range(0x80, 0xC0))


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside runs of ``window`` words that the text holds twice or more, from the words' numbers.

    Runs are compared exactly: equal runs of 1, 2, 4, 8 words get equal numbers.
    """
    n = len(ids)
    if n <= window or int(ids.max()) == n - 1:
        return 0
    length = 1
    while length < window:
        step = min(length, window - length)
        _, ids = np.unique(ids[:-step] * n + ids[step:], return_inverse=True)
        length += step
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    depth = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    depth[at] += 1
    depth[at + window] -= 1
    return int((np.cumsum(depth[:-1]) > 0).sum())


def _measure(texts: list[bytes | None]) -> dict[str, list]:
    rows = []
    for text in texts:
        text = text or b""
        raw = np.frombuffer(text, dtype=np.uint8)
        count = np.bincount(raw, minlength=256)
        words = text.split()
        ids = word_numbers(words)
        lines = [line for line in text.split(b"\n") if line.strip()]
        rows.append((
            len(words),
            int(count[~_LATER & ~_SPACE].sum()),
            int(count[_SYMBOLS].sum()),
            len(lines) - len(set(lines)),
            repeated_words(ids),
            len(lines),
            int(count[_CAPITALS].sum()),
            int(count[_DIGITS].sum()),
            int((ids[1:] == ids[:-1]).sum()),
        ))
    return dict(zip(_STATISTICS, map(list, zip(*rows)))) if rows else {n: [] for n in _STATISTICS}


def _values() -> list[str]:
    return list(dict.fromkeys(r.value for r in RULES))


def base_failed() -> Column:
    """The fixed rule that holds for every group."""
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")


def thresholds(measured: DataFrame, keys: list[str]) -> DataFrame:
    """One row per combination of ``keys`` with a low or high bound for each rule of ``RULES``.

    ``measured`` has the statistics. Rows that fail the fixed rule take no part.
    """
    values = _values()
    sketches = measured.where(~base_failed()).groupBy(*keys).agg(
        F.count("*").alias("n"), *(F.expr(f"kll_sketch_agg_double(CAST({v} AS DOUBLE), {SKETCH_SIZE})").alias(f"s{i}") for i, v in enumerate(values))
    )
    levels, sketches = [], stage(sketches, "sketches")
    for depth in range(len(keys), -1, -1):  # own group, then wider ones
        by = keys[:depth]
        merged = sketches if depth == len(keys) else sketches.groupBy(*by).agg(
            F.sum("n").alias("n"), *(F.expr(f"kll_merge_agg_double(s{i})").alias(f"s{i}") for i in range(len(values)))
        )
        levels.append(merged.select(*by, F.struct("n", *(f"s{i}" for i in range(len(values)))).alias(f"level{depth}")))
    out = levels[0]
    for depth, level in zip(range(len(keys) - 1, -1, -1), levels[1:]):
        by = keys[:depth]
        right = level.withColumnsRenamed({k: f"_{k}" for k in by})
        same = F.lit(True)
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(broadcast_checked(right, THRESHOLD_ROWS), same, "left") if by else out.crossJoin(F.broadcast(right))  # one row
        out = out.drop(*(f"_{k}" for k in by))
    def quartiles(level: str, i: int) -> Column:
        return F.expr(f"kll_sketch_get_quantile_double({level}.s{i}, array(0.25D, 0.5D, 0.75D))")

    def weighted(n: Column) -> Callable[[Column, Column], Column]:
        return lambda own, wider: (own * n + wider * F.lit(GROUP_ROWS)) / (n + F.lit(GROUP_ROWS))

    def blended(i: int) -> Column:
        q = quartiles("level0", i)
        for depth in range(1, len(keys) + 1):
            q = F.zip_with(quartiles(f"level{depth}", i), q, weighted(F.col(f"level{depth}.n")))
        return q

    out = out.select(*keys, *(blended(i).alias(f"q{i}") for i in range(len(values))))
    bounds = []
    for rule in RULES:
        q = f"q{values.index(rule.value)}"
        spread = f"greatest({rule.reach}D * ({q}[2] - {q}[0]), {rule.slack}D)"
        bounds.append(F.expr(f"{q}[0] - {spread}" if rule.side == "low" else f"{q}[2] + {spread}").alias(rule.name))
    return out.select(*keys, *bounds)


def _judged(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and ``broken``, the names of the adaptive rules a row breaks."""
    bounds = thresholds(measured, keys).withColumnsRenamed({k: f"b{i}" for i, k in enumerate(keys)})
    bounds = broadcast_checked(stage(bounds, "thresholds"), THRESHOLD_ROWS)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"b{i}"))
    tests = [
        F.when(F.expr(f"{r.value} {'<' if r.side == 'low' else '>'} {r.name}"), F.lit(r.name)) for r in RULES
    ]
    failed = base_failed()
    return measured.join(bounds, same, "left").select(
        *measured.columns,
        failed.alias("base_failed"),
        F.when(failed, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*tests))).alias("broken"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the statistics, ``base_failed``, ``broken`` and ``kept``.

    Words are runs of characters other than ASCII white space; of the lines between
    line breaks, those with a word count. Null and empty texts have no words and fail
    the fixed rule. Null languages or sources form groups of their own. Repeated rows
    are judged alike and each counts in the thresholds. A group with n rows that pass
    the fixed rule has the weight n / (n + 200) against its language, and a language
    likewise against the corpus. Other columns are not read; an empty table gives an empty one.
    """
    keep = [id_col, *keys]
    measured = stage(per_text(docs, text_col, keep, _measure, {n: "bigint" for n in _STATISTICS}), "statistics")
    return _judged(measured, [f"_{i + 1}" for i in range(len(keys))]).select(
        F.col("_0").alias(id_col), *_STATISTICS, "base_failed", "broken", "kept"
    )


def keep_good(docs: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns; the texts are measured once.

    Only the statistics come back from Python. Null and empty texts go, repeated rows
    go or stay together, texts of any length are measured whole, an empty table gives
    an empty one.
    """
    small_batches(docs.sparkSession)
    measure = text_udf(_measure, {n: "bigint" for n in _STATISTICS})
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), measure(text_col).alias("_m"))
    measured = stage(rows.select("_row", *(f"_k{i}" for i in range(len(keys))), "_m.*"), "measured")
    return _judged(measured, [f"_k{i}" for i in range(len(keys))]).where("kept").select("_row.*")
