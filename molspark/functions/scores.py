"""Arithmetic column builders: accessibility score, display precision, errors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the accessibility score.
UNKNOWN_FRAGMENT = -4.0
RAW_MIN, RAW_MAX = -4.0, 2.5
SCORE_LIMIT = 5.0


def complexity(n_atoms: Column, n_chiral: Column, n_spiro: Column, n_bridge: Column, n_macro: Column) -> Column:
    """Size, stereo, spiro, bridge and macrocycle penalties, as a negative term."""
    atoms = n_atoms.cast("double")
    penalties = (
        (F.pow(atoms, 1.005) - atoms)
        + F.log10(n_chiral + 1)
        + F.log10(n_spiro + 1)
        + F.log10(n_bridge + 1)
        + F.when(n_macro > 0, F.log10(F.lit(2.0))).otherwise(0.0)
    )
    return -penalties


def symmetry_bonus(n_atoms: Column, n_bits: Column) -> Column:
    return F.when(n_atoms > n_bits, 0.5 * F.log(n_atoms.cast("double") / n_bits)).otherwise(0.0)


def rescale_score(raw: Column, smooth: bool = True) -> Column:
    """Raw sum to the 1 (easy) to 10 (hard) range."""
    scaled = 11.0 - (raw - RAW_MIN + 1.0) / (RAW_MAX - RAW_MIN) * 9.0
    if smooth:
        scaled = F.when(scaled > 8.0, 8.0 + F.log(scaled - 8.0)).otherwise(scaled)
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), scaled))


def display_precision(value: Column, digits: int) -> Column:
    """Format width and decimals by magnitude, e.g. ``1.3`` or ``0.5``."""
    magnitude = F.log10(F.abs(value))
    whole = F.floor(magnitude)
    return (
        F.when(value == 0, F.lit(f"0.{digits - 1}"))
        .when(magnitude >= digits - 1, F.lit("1.0"))
        .when(magnitude > 0, F.concat(F.lit("1."), (F.lit(digits - 1) - whole).cast("string")))
        .otherwise(F.concat(F.lit("0."), (F.abs(whole) + (digits - 1)).cast("string")))
    )


def binary_class(probability: Column) -> Column:
    return (probability > 0.5).cast("int")


def error_bars(value: Column, errors: list[Column], mode: str = "std") -> dict[str, Column]:
    """One error column is a deviation, two are (min, max), three (std, min, max)."""
    if len(errors) == 1:
        return {"err_std": errors[0]}
    if len(errors) == 2:
        return {"err_low": F.abs(errors[0] - value), "err_high": F.abs(errors[1] - value)}
    if len(errors) == 3 and mode == "minmax":
        return {"err_low": F.abs(value - errors[1]), "err_high": F.abs(value - errors[2])}
    if len(errors) == 3 and mode == "std":
        return {"err_std": errors[0]}
    raise ValueError(f"cannot read {len(errors)} error columns in mode {mode!r}")
