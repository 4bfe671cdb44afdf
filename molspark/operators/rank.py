"""Global positions, prefix totals and exact order statistics without a
single-task sort.

``ordered`` range-partitions and sorts once and stages the result, so that every
row has a fixed (partition, position). The carry between partitions has one row
per partition and key, which is what gets joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from molspark.operators.shaping import match_keys
from molspark.staging import broadcast_checked, stage

_PART, _LOCAL = "_part", "_local"
_LOCAL_MASK = (1 << 33) - 1
CARRY_LIMIT = 200_000


def ordered(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Staged rows in (keys, order), with their partition and local position.

    ``order`` must end in a unique column, otherwise ties fall arbitrarily.
    """
    by = [F.col(k) for k in keys] + list(order)
    marked = (
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn(_PART, F.spark_partition_id())
        .withColumn(_LOCAL, F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_MASK)))
    )
    return stage(marked, "ordered")


def ordinal(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "ordinal") -> DataFrame:
    """Position 0, 1, ... of each row in the order, counted per key if given."""
    rows = ordered(df, order, keys)
    keys = list(keys)
    parts = rows.groupBy(*keys, _PART).agg(
        F.count(F.lit(1)).alias("_n"), F.min(_LOCAL).alias("_first")
    )
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        *keys, _PART, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    # one row per partition, and per key it holds
    carry = F.broadcast(carry) if not keys else broadcast_checked(carry, CARRY_LIMIT)
    return match_keys(rows, carry, [*keys, _PART]).withColumn(
        name, F.col(_LOCAL) + F.col("_shift")
    ).drop(_PART, _LOCAL, "_shift")


def prefix(
    df: DataFrame,
    order: Sequence[Column],
    totals: dict[str, tuple[str, str]],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running totals; ``totals`` maps a new name to (op, column), op in sum, min, max.

    ``<name>_total`` holds the value over the whole key.
    """
    fn = {"sum": F.sum, "min": F.min, "max": F.max}
    merge = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + b,
        "min": lambda a, b: F.when(a.isNull() | (b < a), b).otherwise(a),
        "max": lambda a, b: F.when(a.isNull() | (b > a), b).otherwise(a),
    }
    rows = ordered(df, order, keys)
    keys = list(keys)
    parts = rows.groupBy(*keys, _PART).agg(*[fn[op](c).alias(f"_t_{n}") for n, (op, c) in totals.items()])
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carry = parts.select(
        *keys, _PART,
        *[fn[op](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (op, _) in totals.items()],
        *[fn[op](f"_t_{n}").over(whole).alias(f"{n}_total") for n, (op, _) in totals.items()],
    )
    if not keys:  # one row per partition
        carry = F.broadcast(carry)
    inside = Window.partitionBy(*keys, _PART).orderBy(_LOCAL).rowsBetween(Window.unboundedPreceding, 0)
    out = match_keys(rows, carry, [*keys, _PART])
    for n, (op, c) in totals.items():
        out = out.withColumn(n, merge[op](F.col(f"_c_{n}"), fn[op](c).over(inside)))
    return out.drop(_PART, _LOCAL, *[f"_c_{n}" for n in totals])


def order_statistics(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: Sequence[str],
    ranks: dict[str, Column] | None = None,
    accuracy: int = 50_000,
) -> DataFrame:
    """Exact values at ranks of ``value`` per key, one row per (key, name).

    A mergeable sketch brackets each probability; only values inside the bracket
    are counted and sorted, after collapsing equal ones. Columns: keys, ``name``,
    ``n``, ``rank`` (0-based, may be fractional), ``at_rank`` (value at its floor) and
    ``stat`` (interpolated between neighbours). ``ranks`` overrides the rank expression, in terms of ``n``; it
    must stay within one row of ``prob * n``.
    """
    keys = list(keys)
    ranks = ranks or {}
    margin = 4.0 / accuracy
    data = df.select(*keys, F.col(value).alias("_x")).where(F.col("_x").isNotNull())
    names = list(probs)
    lows = [max(0.0, probs[n] - margin) for n in names]
    highs = [min(1.0, probs[n] + margin) for n in names]
    sketch = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_x").alias("_min"),
        F.max("_x").alias("_max"),
        F.percentile_approx("_x", lows + highs, accuracy).alias("_q"),
    )
    brackets = sketch.select(
        *keys,
        "n",
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("name"),
                    ranks.get(n, F.lit(probs[n]) * (F.col("n") - 1)).cast("double").alias("rank"),
                    # small groups and the outer ends keep their true extremes
                    F.when((F.col("n") * margin < 3) | (lows[i] == 0.0), F.col("_min"))
                    .otherwise(F.col("_q")[i]).alias("lo"),
                    F.when((F.col("n") * margin < 3) | (highs[i] == 1.0), F.col("_max"))
                    .otherwise(F.col("_q")[i + len(names)]).alias("hi"),
                )
                for i, n in enumerate(names)
            ]
        ).alias("_b"),
    )
    if keys:
        tagged = match_keys(data, brackets, keys).select(*keys, "n", "_x", F.explode("_b").alias("b"))
    else:  # one row: its values become literals, which the scan can filter by
        row, kind = brackets.first(), brackets.schema["_b"].dataType.elementType
        found = [F.struct(*[F.lit(b[f.name]).cast(f.dataType).alias(f.name) for f in kind]) for b in row["_b"]]
        top = max((b["hi"] for b in row["_b"] if b["hi"] is not None), default=None)
        tagged = data.where(F.col("_x") <= F.lit(top)).select(
            F.lit(row["n"]).alias("n"), "_x", F.explode(F.array(*found)).alias("b")
        )
    # everything under the bracket collapses into one null value before the shuffle
    counts = (
        tagged.where("_x <= b.hi")
        .groupBy(*keys, "n", "b.name", "b.rank", F.when(F.expr("_x >= b.lo"), F.col("_x")).alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    run = (
        Window.partitionBy(*keys, "name")
        .orderBy(F.col("_x").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    spans = counts.withColumn("_end", F.sum("_c").over(run))

    def holds(rank):
        return (F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end"))

    lower, upper = holds(F.floor("rank")), holds(F.ceil("rank"))
    at = spans.where(lower | upper).groupBy(*keys, "name", "rank", "n").agg(
        F.max(F.when(lower, F.col("_x"))).alias("at_rank"),
        F.max(F.when(upper, F.col("_x"))).alias("_next"),
    )
    fraction = F.col("rank") - F.floor("rank")
    return at.select(
        *keys, "name", "n", "rank", "at_rank",
        (F.col("at_rank") + fraction * (F.col("_next") - F.col("at_rank"))).alias("stat"),
    )


def has_value(df: DataFrame, column: str) -> Column:
    """Neither null nor, for floating point columns, NaN."""
    real = F.col(column).isNotNull()
    return real & ~F.isnan(column) if df.schema[column].dataType.typeName() in ("double", "float") else real


def kth_value(df: DataFrame, value: str, k: int, n: int) -> object:
    """Exact k-th largest value (1-based) among ``n`` rows."""
    stat = order_statistics(df, value, {"cut": (n - k) / max(n - 1, 1)}, [], {"cut": F.lit(float(n - k))})
    return stat.first()["at_rank"]


def top_rows(df: DataFrame, value: str, unique_id: str, k: int, n: int | None = None) -> DataFrame:
    """The k rows of largest ``value``, ties by ascending numeric id; null and NaN values take no part.

    Column scans find the cut; the rows themselves are then only filtered.
    """
    df = df.where(has_value(df, value))
    n = df.count() if n is None else n
    if k >= n:
        return df
    if k <= 0:
        return df.limit(0)
    cut = kth_value(df, value, k, n)
    tied = df.where(F.col(value) == cut)
    sizes = df.where(F.col(value) >= cut).agg(
        F.count_if(F.col(value) > cut).alias("above"), F.count_if(F.col(value) == cut).alias("tied")
    ).first()
    missing = k - sizes["above"]
    keep = F.col(value) > cut
    if missing < sizes["tied"]:
        last = kth_value(
            tied.select((-F.col(unique_id)).alias("_neg")), "_neg", missing, sizes["tied"]
        )
        keep = keep | ((F.col(value) == cut) & (F.col(unique_id) <= -int(last)))
    else:
        keep = F.col(value) >= cut
    return df.where(keep)
