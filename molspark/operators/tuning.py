"""Training histories, hyper-parameter grids and configuration scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from molspark.functions.hashing import seeded_digest
from molspark.operators.rank import ordinal, prefix
from molspark.operators.scaling import min_max
from molspark.operators.shaping import match_keys
from molspark.staging import stage


def stitch_history(history: DataFrame, run: str = "run", phase: str = "phase", epoch: str = "epoch") -> DataFrame:
    """Per-phase epochs (from 0) to one ``total_epoch`` axis per run.

    Phase lengths are aggregated first; only that small table is ordered.
    """
    lengths = history.groupBy(run, phase).agg((F.max(epoch) + 1).alias("_len"))
    after = prefix(lengths, [F.col(phase)], {"_done": ("sum", "_len")}, [run])
    offsets = after.select(run, phase, (F.col("_done") - F.col("_len")).alias("_offset"))
    return match_keys(history, offsets, [run, phase]).withColumn(
        "total_epoch", F.col(epoch) + F.col("_offset")
    ).drop("_offset")


def after_burn_in(history: DataFrame, ignore_first: int | None = None, n_epochs: int | None = None, epoch: str = "epoch") -> DataFrame:
    """Epochs beyond ``ignore_first``, or the second half of ``n_epochs``."""
    if ignore_first is not None:
        return history.where(F.col(epoch) > ignore_first)
    return history.where(F.col(epoch) >= n_epochs // 2)


def best_epoch(history: DataFrame, run: str = "run", epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """Epoch of lowest loss per run, the first on ties; NaN sorts last and never wins."""
    real = history.where(F.col(loss).isNotNull() & ~F.isnan(loss))
    return real.groupBy(run).agg(
        F.min_by(epoch, F.struct(loss, epoch)).alias("best_epoch"), F.min(loss).alias("best_loss")
    )


def early_stop(history: DataFrame, patience: int, run: str = "run", epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """First epoch with ``patience`` epochs since the best one, per run that stops."""
    seen = history.withColumn("_point", F.struct(F.col(loss).alias("l"), F.col(epoch).alias("e")))
    running = prefix(seen, [F.col(epoch)], {"_best": ("min", "_point")}, [run])
    return running.where(F.col(epoch) - F.col("_best.e") >= patience).groupBy(run).agg(
        F.min(epoch).alias("stop_epoch")
    )


def trial_scores(trials: DataFrame, config: Sequence[str], score: str = "score") -> DataFrame:
    """Mean score per configuration; a NaN repeat counts as infinite."""
    safe = F.when(F.isnan(score), F.lit(float("inf"))).otherwise(F.col(score))
    return trials.groupBy(*config).agg(F.avg(safe).alias("mean_score"))


def best_trial(scores: DataFrame, config: Sequence[str]) -> DataFrame:
    """Configuration of lowest mean score, the smallest values on ties."""
    best = F.min_by(F.struct(*config, "mean_score"), F.struct("mean_score", *config))
    return scores.agg(best.alias("_b")).select("_b.*")


def best_configuration(scores: DataFrame, config: Sequence[str], score: str = "score") -> DataFrame:
    """First row of the scores sorted descending."""
    best = F.min_by(F.struct(*config, score), F.struct((-F.col(score)).alias("_s"), *config))
    return scores.agg(best.alias("_b")).select("_b.*")


def stability_score(preds: DataFrame, config: str = "config_id", weight: str = "weight", pred: str = "pred") -> DataFrame:
    """Variation of variation: per (config, weight) deviation over mean of the
    min-max scaled predictions, then deviation over mean of those per config.

    A weight of constant predictions has no ratio and takes no part; without any
    ratio, or with a mean of 0, the score is null.
    """
    scaled = min_max(preds, pred, "_p", [config, weight])
    ratio = scaled.groupBy(config, weight).agg(F.try_divide(F.stddev_pop("_p"), F.avg("_p")).alias("_r"))
    return ratio.groupBy(config).agg(F.try_divide(F.stddev_pop("_r"), F.avg("_r")).alias("score"))


def least_correlated_weights(preds: DataFrame, weight: str = "weight", sample: str = "sample_id", pred: str = "pred", keep: int = 6) -> DataFrame:
    """``weight, max_corr``: the weights whose sample orderings agree least with any later weight.

    Samples are numbered 0, 1, ... by their id, so gaps between ids have no effect.
    Ordering them by prediction gives one permutation of these numbers per weight; a
    vector per rank holds the number that each weight puts there, and one pass over
    the vectors gives all correlations. Every weight must score every sample.
    """
    numbers = ordinal(preds.select(sample).distinct(), [F.col(sample)], name="_no")
    weights = ordinal(preds.select(weight).distinct(), [F.col(weight)], name="_w")
    placed = preds.join(numbers, sample).join(weights, weight)
    ranked = ordinal(placed, [F.col(pred), F.col("_no")], ["_w"], name="rank")
    entries = F.array_sort(F.collect_list(F.struct("_w", "_no")))  # as many as there are weights
    vectors = ranked.groupBy("rank").agg(F.transform(entries, lambda e: e["_no"].cast("double")).alias("v"))
    matrix = Correlation.corr(vectors.select(array_to_vector("v").alias("v")), "v", "pearson").first()[0].toArray()
    cells = [(i, float(c)) for i, row in enumerate(matrix) for j, c in enumerate(row) if i < j]  # weights squared
    later = preds.sparkSession.createDataFrame(cells, "_w bigint, corr double")
    highest = later.groupBy("_w").agg(F.max("corr").alias("corr"))
    scored = weights.join(highest, "_w", "left").withColumn("max_corr", F.greatest(F.lit(0.0), F.coalesce("corr", F.lit(0.0))))
    return scored.orderBy("max_corr", "_w").limit(keep).select(F.col(weight).cast("double").alias("weight"), "max_corr")


def least_correlated_by(preds: DataFrame, config: str, weight: str = "weight", sample: str = "sample_id", pred: str = "pred", keep: int = 6) -> DataFrame:
    """``config, weight, max_corr``: :func:`least_correlated_weights` for many configurations at once.

    Every weight orders the same numbers 0 ... n-1, so the sums of products of two
    orderings tell their correlation. A task adds up the products of all pairs of
    weights for the ranks that it holds; one matrix per task and configuration moves.
    """
    numbers = ordinal(preds.select(sample).distinct(), [F.col(sample)], name="_no")
    weights = stage(ordinal(preds.select(weight).distinct(), [F.col(weight)], name="_w"), "weights")
    placed = preds.join(numbers, sample).join(weights, weight).select(config, F.col("_w").cast("int"), pred, "_no")  # what is sorted and staged
    ranked = ordinal(placed, [F.col(pred), F.col("_no")], [config, "_w"], name="rank")
    entries = F.array_sort(F.collect_list(F.struct("_w", "_no")))  # as many as there are weights
    vectors = ranked.groupBy(config, "rank").agg(F.transform(entries, lambda e: e["_no"].cast("double")).alias("v"))
    kind = preds.schema[config].dataType.simpleString()

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            names, rows = batch.column(0).to_pylist(), batch.column(1)
            matrix = rows.flatten().to_numpy().reshape(len(names), -1)
            for name in set(names):
                own = matrix[[n == name for n in names]]
                held[name] = held.get(name, 0) + own.T @ own
        if held:
            lists = pa.array([m.ravel() for m in held.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), batch.schema.field(0).type), lists], ["c", "m"])

    partial = vectors.select(F.col(config).alias("c"), "v").mapInArrow(products, f"c {kind}, m array<double>")
    sums = partial.select("c", F.posexplode("m").alias("at", "x")).groupBy("c", "at").agg(F.sum("x").alias("x"))
    size = numbers.agg(F.count(F.lit(1)).alias("n")).crossJoin(weights.agg(F.count(F.lit(1)).alias("k")))  # one row
    mean, n = (F.col("n") - 1) / 2.0, F.col("n")
    corr = F.try_divide(F.col("x") - n * mean * mean, n * (n * n - 1) / 12.0)
    cells = sums.crossJoin(F.broadcast(size)).select("c", F.expr("at DIV k").alias("_w"), F.expr("at % k").alias("_o"), corr.alias("corr"))
    highest = cells.groupBy("c", "_w").agg(F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("_o") > F.col("_w"), F.col("corr"))), F.lit(0.0))).alias("max_corr"))
    # a configuration has one row per weight
    order = Window.partitionBy("c").orderBy("max_corr", "_w")
    kept = highest.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= keep)
    return kept.join(F.broadcast(weights), "_w").select(F.col("c").alias(config), F.col(weight).cast("double").alias("weight"), "max_corr")


def common_weights(chosen: DataFrame, weight: str = "weight") -> DataFrame:
    """Second to sixth most frequent values, ties by ascending value."""
    counts = chosen.groupBy(weight).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(weight)).offset(1).limit(5)


def parameter_grid(spark: SparkSession, bounds: dict[str, Sequence]) -> DataFrame:
    """All combinations of the bound lists, one column per parameter; each row follows from its number, in any task."""
    total, columns = 1, []
    for name, values in reversed(list(bounds.items())):
        place = F.expr(f"CAST(id DIV {total} % {max(1, len(values))} AS INT)")
        columns.append(F.get(F.array(*[F.lit(v) for v in values]), place).alias(name))
        total *= len(values)
    return spark.range(total).select(*reversed(columns))


def crossed_values(columns: dict[str, DataFrame]) -> DataFrame:
    """All combinations of the distinct values of some one-column tables, nulls left out; nothing is collected."""
    grid = None
    for name, values in columns.items():
        own = values.select(F.col(values.columns[0]).alias(name)).where(F.col(name).isNotNull()).distinct()
        grid = own if grid is None else grid.crossJoin(own)
    return grid


def with_parameters(df: DataFrame, bounds: dict[str, Sequence]) -> DataFrame:
    """Every row under every combination, expanded inside its task."""
    for name, values in bounds.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df


def draw_configurations(grid: DataFrame, n: int = 20, seed: int = 21) -> DataFrame:
    """``n`` different configurations in seeded order."""
    digest = seeded_digest(seed, *[F.col(c) for c in grid.columns])
    return grid.orderBy(digest, *grid.columns).limit(n)


# The factors and the powers of ten of the weight grid.
GRID_FACTORS, GRID_POWERS = (1, 3, 6), range(-6, 6)


def weight_grid() -> list[float]:
    """Every factor times every power of ten, ascending."""
    return sorted(factor * 10.0**power for factor in GRID_FACTORS for power in GRID_POWERS)
