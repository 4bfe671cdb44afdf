"""Cross-validated ensembles of MLlib models over token-count features."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import islice
from multiprocessing.pool import ThreadPool
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from molspark.functions.hashing import fragment_id, uniform
from molspark.functions.tokens import SENTINEL, TOKEN_PATTERN, bound, join_strings, ngrams, tokenize
from molspark.operators import ensemble, metrics, splits, tuning
from molspark.operators.augment import explode_variants, split_rejected
from molspark.operators.scaling import fit_robust, fit_robust_columns, inverse_transform
from molspark.staging import stage

FITS_AT_ONCE = 4
GRAMS_KEPT = 200_000  # digests that a task remembers
# Cumulative probabilities of a unit Poisson count, for bootstrap weights.
_POISSON_ONE = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563]


@dataclass
class Ensemble:
    """Fitted members by (fold, run), with the scalers of each fold."""

    members: dict[tuple[int, int], object]
    scaler: DataFrame | None
    folds: int
    runs: int
    n_features: int
    kind: str
    extra_scales: tuple = ()  # per fold: (center, scale) of each extra column

    def spark(self) -> SparkSession:
        return SparkSession.active() if self.scaler is None else self.scaler.sparkSession

    def predict(self, variants: DataFrame, text: str = "variant") -> DataFrame:
        """Every variant under every member: input columns, fold, run, pred."""
        return self.score(featurise(variants, text, self.n_features).drop(text))

    def score(self, rows: DataFrame) -> DataFrame:
        """The same for rows that already carry ``features`` (and ``extras``); all members
        score in one stage, then the row is repeated."""
        if self.extra_scales and "extras" not in rows.columns:
            raise ValueError("the ensemble was trained with extra columns, which the input lacks")
        cols = [c for c in rows.columns if c not in ("features", "extras")]
        for fold in sorted({f for f, _ in self.members}):
            rows = member_features(rows, f"_f_{fold}", self.extra_scales[fold] if self.extra_scales else ())
        entries = []
        for (fold, run), model in self.members.items():
            name = f"_p_{fold}_{run}"
            model = model.copy().setFeaturesCol(f"_f_{fold}")
            if self.kind == "classification":
                model.setProbabilityCol(name).setPredictionCol("").setRawPredictionCol("")
                pred = vector_to_array(F.col(name))[1]
            else:
                model.setPredictionCol(name)
                pred = F.col(name)
            rows = model.transform(rows)
            entries.append(F.struct(F.lit(fold).alias("fold"), F.lit(run).alias("run"), pred.alias("pred")))
        long = rows.select(*cols, F.explode(F.array(*entries)).alias("_e")).select(*cols, "_e.*")
        return long if self.scaler is None else inverse_transform(long, self.scaler, "pred", "pred")

    def of_fold(self, fold: int) -> "Ensemble":
        return replace(self, members={m: v for m, v in self.members.items() if m[0] == fold})

    def infer(self, df: DataFrame, text: str | Sequence[str], key: str, variants: Column | None = None, extras: Sequence[str] = ()) -> DataFrame:
        """Input rows with ``mean, sigma``; rows without usable variants keep nulls."""
        rows = df.withColumn("variants", F.array(row_text(text)) if variants is None else variants)
        good, _ = split_rejected(rows)
        keep = [key] if not extras else [key, extra_array(extras)]
        preds = self.predict(explode_variants(good.select(*keep, "variants")))
        return ensemble.attach(df, ensemble.mean_sigma(preds, key), key)


def row_text(text: str | Sequence[str]) -> Column:
    """The row's string; several strings of a row are joined into one."""
    return F.col(text) if isinstance(text, str) else join_strings(F.array(*(F.coalesce(F.col(c), F.lit("")) for c in text)))


def extra_array(extras: Sequence[str]) -> Column:
    return F.array(*(F.col(c).cast("double") for c in extras)).alias("extras")


def member_features(rows: DataFrame, name: str, scales: Sequence[tuple[float, float]]) -> DataFrame:
    """Features of one fold's models: hashed counts, then the extras by the fold's scales (0 where missing)."""
    if not scales:
        return rows.withColumn(name, F.col("features"))
    scaled = [F.coalesce((F.col("extras")[i] - center) / scale, F.lit(0.0)) for i, (center, scale) in enumerate(scales)]
    rows = rows.withColumn("_extra", array_to_vector(F.array(*scaled)))
    return VectorAssembler(inputCols=["features", "_extra"], outputCol=name).transform(rows).drop("_extra")


def hashed_grams(text: Column, n_features: int) -> Column:
    """Feature numbers of a string's tokens and token pairs, repeats included."""
    grams = bound(tokenize(F.coalesce(text, F.lit(""))), lambda t: F.concat(t, ngrams(t, 2)))
    return F.transform(grams, lambda g: (fragment_id(g) % n_features).cast("int"))


def _gram_counter(n_features: int) -> Callable[[str | None], np.ndarray]:
    """The counts of :func:`hashed_grams` for one string, digests of known grams kept."""
    matches, known = re.compile(TOKEN_PATTERN).findall, {}

    def count(text: str | None) -> np.ndarray:
        tokens = [SENTINEL, *matches(text or ""), SENTINEL]
        grams = Counter(tokens)
        grams.update(map(add, tokens, islice(tokens, 1, None)))
        if len(known) > GRAMS_KEPT:
            known.clear()
        for gram in grams.keys() - known.keys():
            known[gram] = int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % n_features
        places = np.fromiter(map(known.__getitem__, grams), np.int64, len(grams))
        return np.bincount(places, np.fromiter(grams.values(), np.float64, len(grams)), n_features)

    return count


def featurise(df: DataFrame, text: str, n_features: int) -> DataFrame:
    """Hashed counts of tokens and token pairs in ``features``.

    The strings alone go to Python, in bounded batches; a digest per different gram of a
    string is looked up, where an expression makes one per occurrence.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22)

    @F.arrow_udf("array<double>")
    def counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = _gram_counter(n_features)
        for batch in texts:
            rows = [count(t) for t in batch.to_pylist()]
            flat = np.concatenate(rows) if rows else np.zeros(0)
            yield pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * n_features, flat)

    return df.withColumn("features", array_to_vector(counted(F.col(text))))


def bootstrap_weight(seed: int, *keys: Column) -> Column:
    """Poisson(1) resampling count from the row key."""
    u = uniform(seed, *keys)
    weight = F.lit(len(_POISSON_ONE))
    for count, p in reversed(list(enumerate(_POISSON_ONE))):
        weight = F.when(u < p, count).otherwise(weight)
    return weight.cast("double")


def plan_folds(df: DataFrame, row_id: str, text: str, target: str, k: int, kind: str) -> DataFrame:
    """``row_id, fold``: groups of equal strings, or stratified classes."""
    if kind == "classification":
        return splits.stratified_kfold(df.select(row_id, target), row_id, target, k).select(row_id, "fold")
    return splits.group_kfold(df.select(row_id, text), text, k).select(row_id, "fold")


def _estimator(kind: str, reg_param: float = 0.01, elastic_net: float = 0.0, max_iter: int = 20, standardize: bool = True):
    common = dict(
        featuresCol="features", labelCol="_y", weightCol="_w", regParam=float(reg_param), elasticNetParam=float(elastic_net),
        maxIter=int(max_iter), standardization=bool(standardize),
    )
    if kind == "classification":
        return LogisticRegression(**common)
    return LinearRegression(solver="auto", **common)  # by normal equations up to 4,096 features without an L1 part


@dataclass
class Prepared:
    """Staged inputs of all folds; each row's features are stored once."""

    rows: DataFrame      # row_id, text, target, fold (own fold of each row)
    table: DataFrame     # row_id, target, splits (part of the row under each fold's models), variant, features, extras
    scaler: DataFrame | None
    scales: tuple        # per fold: center and scale of the target
    extra_scales: tuple
    folds: int
    n_features: int
    kind: str

    def part(self, fold: int, *splits: str) -> DataFrame:
        """Rows of a fold's split with the scaled target ``_y``."""
        center, scale = self.scales[fold] if self.scales else (0.0, 1.0)
        rows = self.table.withColumn("split", F.col("splits")[fold]).where(F.col("split").isin(*splits))
        return rows.withColumn("_y", (F.col("target") - center) / scale)


def _fold_scales(each: DataFrame, column: str, k: int) -> tuple[DataFrame, list[tuple[float, float]]]:
    """Robust center and scale of a column over each fold's training rows: a table, and the same by fold."""
    scaler = stage(fit_robust(each.where("split = 'train'"), column), "scaler")
    found = {r["fold"]: (r["center"], r["scale"]) for r in scaler.collect()}  # one row per fold
    return scaler, [found.get(fold, (0.0, 1.0)) for fold in range(k)]


def _extra_scales(each: DataFrame, n: int, k: int) -> list[tuple[tuple[float, float], ...]]:
    """Per fold the center and scale of each of ``n`` extras, all found together."""
    train = each.where("split = 'train'")
    fitted = fit_robust_columns(train.select("fold", *(F.col("extras")[i].alias(str(i)) for i in range(n))), [str(i) for i in range(n)])
    found = {(r["fold"], int(r["column"])): (r["center"], r["scale"]) for r in fitted.collect()}  # one row per fold and column
    return [tuple(found.get((fold, i), (0.0, 1.0)) for i in range(n)) for fold in range(k)]


def prepare(
    df: DataFrame, row_id: str, text: str | Sequence[str], target: str, k: int = 2, n_features: int = 256,
    kind: str = "regression", variants: Column | None = None, extras: Sequence[str] = (),
) -> Prepared:
    """Folds, splits, scaling on training rows, variants and features.

    ``text`` names one string column or several that belong together, ``extras``
    numeric columns that the models get besides, scaled per fold.
    """
    base = df.select(
        F.col(row_id).alias("row_id"), row_text(text).alias("text"), F.col(target).cast("double").alias("target"),
        extra_array(extras) if extras else F.array().cast("array<double>").alias("extras"),
        (F.array(row_text(text)) if variants is None else variants).alias("variants"),
    )
    base = stage(base, "input")
    folds = plan_folds(base, "row_id", "text", "target", k, kind)
    rows = stage(base.join(folds, "row_id"), "folds")
    each = splits.cross_validation_splits(rows.select("row_id", "target", "extras", "fold"), "row_id", k)
    each = stage(each, "splits")
    scaler, scales = _fold_scales(each, "target", k) if kind == "regression" else (None, [])
    extra_scales = _extra_scales(each, len(extras), k) if extras else ()
    parts = each.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("fold", "split"))).alias("_s"))  # one per fold
    whole = rows.join(parts.select("row_id", F.col("_s.split").alias("splits")), "row_id").drop("fold")
    exploded = explode_variants(split_rejected(whole)[0])
    table = stage(featurise(exploded, "variant", n_features).drop("text"), "features")
    return Prepared(rows.drop("extras", "variants"), table, scaler, tuple(scales), tuple(extra_scales), k, n_features, kind)


def train_ensemble(
    data: Prepared, n_runs: int = 2, reg_param: float = 0.01, seed: int = 11,
    fold_subset: Sequence[int] | None = None, run_subset: Sequence[int] | None = None,
) -> Ensemble:
    """One distributed fit per (fold, run) on seeded bootstrap weights; a few run side by side."""
    names = [(f, r) for f in (range(data.folds) if fold_subset is None else fold_subset) for r in (range(n_runs) if run_subset is None else run_subset)]

    def fit(name: tuple[int, int]):
        fold, run = name
        train = member_features(data.part(fold, "train"), "_f", data.extra_scales[fold] if data.extra_scales else ())
        weighted = train.withColumn("_w", bootstrap_weight(seed, F.col("row_id"), F.lit(fold), F.lit(run))).where("_w > 0")
        return _estimator(data.kind, reg_param=reg_param).fit(weighted.select(F.col("_f").alias("features"), "_y", "_w"))

    with ThreadPool(FITS_AT_ONCE) as pool:
        members = dict(zip(names, pool.map(fit, names)))
    return Ensemble(members, data.scaler, data.folds, n_runs, data.n_features, data.kind, data.extra_scales)


def member_predictions(model: Ensemble, data: Prepared) -> DataFrame:
    """``row_id, fold, split, target, run, pred`` of every row and variant under every member."""
    parts = None
    for fold in sorted({f for f, _ in model.members}):
        rows = data.part(fold, "train", "valid", "test").select("row_id", "split", "target", "features", *(["extras"] if data.extra_scales else []))
        preds = model.of_fold(fold).score(rows)
        parts = preds if parts is None else parts.unionByName(preds)
    return parts


def out_of_fold(model: Ensemble, data: Prepared) -> DataFrame:
    """``row_id, fold, split, target, mean, sigma`` of every row under every fold's models."""
    return member_predictions(model, data).groupBy("row_id", "fold", "split", "target").agg(
        F.avg("pred").alias("mean"), F.stddev_pop("pred").alias("sigma")
    )


def run_scores(model: Ensemble, data: Prepared) -> DataFrame:
    """``fold, run, set`` with the metrics of each single member, variants averaged."""
    each = member_predictions(model, data).groupBy("row_id", "fold", "split", "target", "run").agg(F.avg("pred").alias("mean"))
    each, keys = each.withColumnRenamed("split", "set"), ["fold", "run", "set"]
    if model.kind == "regression":
        return metrics.regression_metrics(each, keys)
    each = stage(each, "each")
    curve = metrics.curve_metrics(metrics.pr_curve(each, keys, "target", "mean"), keys).select(*keys, "pr_auc")
    return metrics.classification_metrics(each, keys, "target", "mean").join(curve, keys)


def predictions_table(base: DataFrame, oof: DataFrame) -> DataFrame:
    """Input rows with their held-out mean and sigma, and the fold that held them out."""
    return ensemble.write_back(base, oof.where("split = 'test'"))


def evaluate(oof: DataFrame, kind: str = "regression", n_mc: int = 1000, true: str = "target") -> DataFrame:
    """Long scores ``fold, set, metric, mean, sigma``; fold -1 holds the final
    cross-validated scores over all held-out rows that have a prediction."""
    rows = metrics.drop_unpredicted(oof).withColumnRenamed("split", "set")
    final = rows.where("set = 'test'").withColumns({"fold": F.lit(-1), "set": F.lit("final")})
    both = rows.unionByName(final)
    keys = ["fold", "set"]
    if kind == "regression":
        wide = metrics.regression_metrics(both, keys, true, "mean", "sigma")
        return metrics.metrics_long(wide, keys, metrics.REGRESSION)
    both = stage(both.withColumn("_id", F.concat_ws("|", "row_id", "fold", "set")), "scored")
    wide = (
        metrics.curve_metrics(metrics.pr_curve(both, keys, true, "mean"), keys)
        .join(metrics.classification_sigma(both, "_id", keys, n_mc, true=true, pred="mean"), keys)
    )
    return metrics.metrics_long(wide, keys, metrics.CLASSIFICATION)


def final_scores(long: DataFrame, kind: str = "regression") -> DataFrame:
    """One wide row of the final scores."""
    names = metrics.REGRESSION if kind == "regression" else metrics.CLASSIFICATION
    return metrics.score_table(long.where("fold = -1"), sets=("final",), metrics=names).drop("fold")


def fold_scores(long: DataFrame, kind: str = "regression") -> DataFrame:
    names = metrics.REGRESSION if kind == "regression" else metrics.CLASSIFICATION
    return metrics.score_table(long.where("fold >= 0"), metrics=names)


def hyperparameter_trials(data: Prepared, configs: DataFrame, n_runs: int = 2, seed: int = 21) -> DataFrame:
    """The rows of ``configs`` (one column per parameter of the models) with ``run, score``.

    Every different configuration is fitted once per run on the first fold; the fits
    share the staged training rows and a few run side by side. All fitted models then
    score the validation rows in one stage; ``score`` is their mean squared error, or
    the log loss of a classifier.
    """
    spark, names = data.table.sparkSession, configs.columns
    known = [tuple(r) for r in configs.distinct().orderBy(*names).collect()]  # each is fitted here
    scales = data.extra_scales[0] if data.extra_scales else ()
    train = stage(member_features(data.part(0, "train"), "_f", scales).select("row_id", F.col("_f").alias("features"), "_y"), "train")

    def fit(task: tuple[int, int]):
        number, run = task
        weighted = train.withColumn("_w", bootstrap_weight(seed, F.col("row_id"), F.lit(0), F.lit(run))).where("_w > 0")
        return _estimator(data.kind, **dict(zip(names, known[number]))).fit(weighted)

    tasks = [(k, r) for k in range(len(known)) for r in range(n_runs)]
    with ThreadPool(FITS_AT_ONCE) as pool:
        fitted = pool.map(fit, tasks, chunksize=1)
    valid = data.part(0, "valid").select("row_id", "_y", "features", *(["extras"] if data.extra_scales else []))
    trial = Ensemble({(0, i): m for i, m in enumerate(fitted)}, None, 1, len(fitted), data.n_features, data.kind, data.extra_scales)
    preds = trial.score(valid).withColumnRenamed("run", "_t")
    if data.kind == "classification":
        p = F.least(F.greatest(F.col("pred"), F.lit(1e-15)), F.lit(1 - 1e-15))
        loss = -(F.col("_y") * F.log(p) + (1 - F.col("_y")) * F.log(1 - p))
    else:
        loss = (F.col("pred") - F.col("_y")) ** 2
    errors = preds.groupBy("_t").agg(F.avg(loss).alias("score"))
    kinds = ", ".join(f"`{c}` {configs.schema[c].dataType.simpleString()}" for c in names)
    table = spark.createDataFrame([(i, r, *known[k]) for i, (k, r) in enumerate(tasks)], f"_t int, run int, {kinds}")
    return table.join(errors, "_t", "left").select(*names, "run", F.coalesce("score", F.lit(float("inf"))).alias("score"))


def select_hyperparameters(
    data: Prepared, bounds: dict[str, Sequence], n_draws: int | None = None, n_runs: int = 2, seed: int = 21,
) -> DataFrame:
    """Mean validation error of each configuration on the first fold, best first.

    ``bounds`` lists values of ``reg_param``, ``elastic_net``, ``max_iter`` or
    ``standardize``; all combinations are tried, or ``n_draws`` of them in seeded order.
    """
    grid = tuning.parameter_grid(data.table.sparkSession, bounds)
    if n_draws is not None:
        grid = tuning.draw_configurations(grid, n_draws, seed)
    names = list(bounds)
    return tuning.trial_scores(hyperparameter_trials(data, grid, n_runs, seed), names).orderBy("mean_score", *names)
