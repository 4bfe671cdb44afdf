"""Regression and classification metrics with propagated errors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from molspark.functions.hashing import normal, normals
from molspark.functions.scores import binary_class
from molspark.operators.rank import ordinal, prefix
from molspark.operators.shaping import match_keys
from molspark.staging import stage

REGRESSION = ["rmse", "mae", "r2"]
REPLICA_ROWS = 200_000  # rows that may travel to the tasks for their replicas
CELL_ROWS = 1 << 21  # scores of a replica that meet in one task
CLASSIFICATION = ["accuracy", "precision", "recall", "f1", "pr_auc"]


def drop_unpredicted(df: DataFrame, columns: Sequence[str] = ("mean", "sigma")) -> DataFrame:
    """Remove rows whose predictions are null or NaN."""
    return df.na.drop(subset=list(columns))


def regression_metrics(
    df: DataFrame, keys: Sequence[str], true: str = "target", pred: str = "mean", sigma: str | None = None
) -> DataFrame:
    """RMSE, MAE and R2 per key in one pass, with their propagated errors.

    R2 and its error are null for a constant target or a single row, the error of
    the RMSE is 0 for a perfect prediction.
    """
    d = F.col(true) - F.col(pred)
    n = F.count(F.lit(1)).cast("double")
    ss_res = F.sum(d * d)
    ss_tot = F.var_pop(true) * n
    out = [
        F.sqrt(ss_res / n).alias("rmse"),
        (F.sum(F.abs(d)) / n).alias("mae"),
        (1 - F.try_divide(ss_res, ss_tot)).alias("r2"),
    ]
    if sigma is not None:
        e2 = F.col(sigma) * F.col(sigma)
        weighted = F.sum(d * d * e2)
        out += [
            F.when(ss_res == 0, 0.0).otherwise(F.sqrt(F.try_divide(weighted / n, ss_res))).alias("rmse_sigma"),
            (F.sqrt(F.sum(e2)) / n).alias("mae_sigma"),
            F.try_divide(2 * F.sqrt(weighted), ss_tot).alias("r2_sigma"),
        ]
    return df.groupBy(*keys).agg(*out)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def confusion_counts(df: DataFrame, keys: Sequence[str], true: str = "target", pred: str = "pred") -> DataFrame:
    hit, cls = F.col(true) == 1, binary_class(F.col(pred)) == 1
    return df.groupBy(*keys).agg(
        F.count_if(hit & cls).alias("tp"),
        F.count_if(~hit & cls).alias("fp"),
        F.count_if(hit & ~cls).alias("fn"),
        F.count_if(~hit & ~cls).alias("tn"),
    )


def _counts_to_metrics(keys: Sequence[str | Column]) -> list[str | Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return [
        *keys,
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def classification_metrics(df: DataFrame, keys: Sequence[str], true: str = "target", pred: str = "pred") -> DataFrame:
    """Accuracy, precision, recall and F1 at 0.5; zero where undefined."""
    return confusion_counts(df, keys, true, pred).select(*_counts_to_metrics(keys))


def confusion_matrix(df: DataFrame, keys: Sequence[str] = (), true: str = "target", pred: str = "pred") -> DataFrame:
    """Rows observed class, columns ``pred_0`` and ``pred_1``."""
    cls = df.withColumn("_p", binary_class(F.col(pred)))
    wide = cls.groupBy(*keys, true).pivot("_p", [0, 1]).agg(F.count(F.lit(1)))
    return wide.na.fill(0, ["0", "1"]).withColumnsRenamed({"0": "pred_0", "1": "pred_1"})


def pr_curve(df: DataFrame, keys: Sequence[str], true: str = "target", pred: str = "pred") -> DataFrame:
    """One point per distinct score: ``threshold, precision, recall, f1``.

    Equal scores collapse before the running totals, which are taken over range
    partitions, so neither a large key nor a frequent score lands in one task.
    """
    keys = list(keys)
    levels = df.groupBy(*keys, F.col(pred).alias("threshold")).agg(
        F.sum(F.col(true).cast("bigint")).alias("_pos"), F.count(F.lit(1)).alias("_all")
    )
    points = prefix(
        levels, [F.col("threshold").desc()], {"tp": ("sum", "_pos"), "taken": ("sum", "_all")}, keys
    )
    points = points.withColumnsRenamed({"tp_total": "positives", "taken_total": "n"})
    precision = F.col("tp") / F.col("taken")
    # without positives recall is 1 by convention
    recall = F.when(F.col("positives") == 0, 1.0).otherwise(F.col("tp") / F.col("positives"))
    points = points.withColumns({"precision": precision, "recall": recall})
    p, r = F.col("precision"), F.col("recall")
    return points.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def _trapezoid() -> Column:
    """Area of one curve step, starting from (recall 0, precision 1).

    The previous point of a level follows from its own counts, so no window is
    needed: before adding its ``_all`` rows there were ``taken - _all``.
    """
    prev_taken = F.col("taken") - F.col("_all")
    prev_tp = F.col("tp") - F.col("_pos")
    prev_precision = F.when(prev_taken == 0, 1.0).otherwise(prev_tp / prev_taken)
    # with no positives the curve starts at recall 0 and jumps to 1 at once
    width = F.when(F.col("positives") > 0, F.col("_pos") / F.col("positives")).otherwise(
        F.when(prev_taken == 0, 1.0).otherwise(0.0)
    )
    return width * (F.col("precision") + prev_precision) / 2


def pr_auc(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trapezoid area under the curve."""
    return curve.groupBy(*keys).agg(F.sum(_trapezoid()).alias("pr_auc"))


def curve_metrics(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All five metrics from the curve: the point of the lowest threshold above
    0.5 holds the counts of the 0.5 classifier."""
    above = F.col("threshold") > 0.5
    at = lambda c: F.coalesce(F.max(F.when(above, F.col(c))), F.lit(0))
    sums = curve.groupBy(*keys).agg(
        at("tp").alias("tp"), (at("taken") - at("tp")).alias("fp"),
        (F.max("positives") - at("tp")).alias("fn"),
        (F.max("n") - F.max("positives") - at("taken") + at("tp")).alias("tn"),
        F.sum(_trapezoid()).alias("pr_auc"),
    )
    return sums.select(*_counts_to_metrics(keys), "pr_auc")


def best_threshold(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Threshold of largest F1; the lowest threshold on ties."""
    best = F.max_by(
        F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold"))
    )
    return curve.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.threshold", "_b.f1")


def positive_share(df: DataFrame, keys: Sequence[str], true: str = "target") -> DataFrame:
    """Precision of a random classifier."""
    return df.groupBy(*keys).agg(F.avg(F.col(true).cast("double")).alias("random_precision"))


def noisy_replicas(df: DataFrame, row_id: str, n_mc: int, seed: int, pred: str = "pred", sigma: str = "sigma") -> DataFrame:
    """Each row ``n_mc`` times with Gaussian noise drawn from row key and replica.

    The few input rows are dealt out first, so that the many replicas are made by
    all cores.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    reps = df.repartition(parts, F.col(row_id)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_mc - 1))))
    noise = normal(seed, F.col(row_id), F.col("rep")) * F.col(sigma)
    return reps.withColumn(pred, F.col(pred) + noise)


def _score_metrics(target: np.ndarray, score: np.ndarray) -> list[float]:
    """The five metrics of one group, as :func:`curve_metrics` defines them."""
    hit, called, n = target == 1, score > 0.5, len(score)
    tp = int((hit & called).sum())
    fp, fn = int(called.sum()) - tp, int(hit.sum()) - tp
    ratio = lambda top, bottom: top / bottom if bottom else 0.0
    order = np.argsort(-score, kind="stable")
    last = np.flatnonzero(np.r_[score[order][1:] != score[order][:-1], True])  # equal scores are one step
    taken, found = (last + 1).astype(float), np.cumsum(hit[order])[last].astype(float)
    positives = found[-1]
    precision = np.r_[1.0, found / taken]
    recall = np.r_[0.0, found / positives] if positives else np.r_[0.0, np.ones(len(found))]
    area = float((np.diff(recall) * (precision[1:] + precision[:-1]) / 2).sum())
    return [(n - fp - fn) / n, ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn), area]


def _replica_metrics(rows: pa.Table, spark: SparkSession, n_mc: int, seed: int) -> DataFrame:
    """``_g, rep`` and the metrics of every group and replica; ``rows`` (_g, _id, _y, _p, _s) travel to the tasks, which share the replicas."""
    group = rows["_g"].to_numpy()
    order = np.argsort(group, kind="stable")
    group, target, pred, sigma = group[order], rows["_y"].to_numpy()[order], rows["_p"].to_numpy()[order], rows["_s"].to_numpy()[order]
    prefixes = np.array([f"{seed}|{i}|".encode() for i in rows["_id"].take(pa.array(order)).to_pylist()])
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist()
    spans = [(int(group[i]), i, j) for i, j in zip(starts, [*starts[1:], len(group)])]
    shared = spark.sparkContext.broadcast((target, pred, sigma, prefixes, spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, pred, sigma, prefixes, spans = shared.value
        for batch in batches:
            out = []
            for rep in batch.column(0).to_pylist():
                score = pred + normals(prefixes, str(rep).encode()) * sigma
                out += [(g, rep, *_score_metrics(target[i:j], score[i:j])) for g, i, j in spans]
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 5)], ["_g", "rep", *CLASSIFICATION])

    replicas = spark.range(0, n_mc, 1, min(n_mc, 4 * spark.sparkContext.defaultParallelism))
    return replicas.mapInArrow(run, "_g bigint, rep bigint, " + ", ".join(f"{m} double" for m in CLASSIFICATION))


def _sortable(score: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the scores, equal for equal ones."""
    bits = (score + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _packed(order: np.ndarray, hit: np.ndarray) -> bytes:
    """Ascending numbers as differences, bytes of equal place together (most are zero), then a bit per hit."""
    steps = np.diff(order.view(np.uint64), prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes() + np.packbits(hit).tobytes()


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(data, np.uint8, 8 * n).reshape(8, n)
    steps = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)
    return np.cumsum(steps, dtype=np.uint64).view(np.int64), np.unpackbits(np.frombuffer(data, np.uint8, offset=8 * n), count=n).astype(bool)


def _dealt_scores(rows: DataFrame, n_mc: int, seed: int, edges: Sequence[float], whole: bool) -> DataFrame:
    """``_g, rep, cell, n, pos, data``: per task, group, replica and range of scores their numbers, and with ``whole`` the sorted scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, target, pred, sigma = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3, 4))
            prefixes = np.array([f"{seed}|{i}|".encode() for i in batch.column(1).to_pylist()])
            hit, names = target == 1, np.unique(group)
            own = np.searchsorted(names, group)
            for rep in range(n_mc):
                score = pred + normals(prefixes, str(rep).encode()) * sigma
                cell = np.searchsorted(edges, score) if len(edges) else np.zeros(len(score), np.int64)
                key = _sortable(score)
                order = np.lexsort((key, cell, own)) if len(edges) or len(names) > 1 else np.argsort(key)
                slot = (own * (len(edges) + 1) + cell)[order]
                starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                ends = np.r_[starts[1:], len(slot)]
                sorted_hit, sorted_key = hit[order], key[order]
                found = np.add.reduceat(sorted_hit, starts, dtype=np.int64)
                data = [_packed(sorted_key[i:j], sorted_hit[i:j]) if whole else None for i, j in zip(starts.tolist(), ends.tolist())]
                columns = [names[slot[starts] // (len(edges) + 1)], np.full(len(starts), rep), slot[starts] % (len(edges) + 1), ends - starts, found]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(data, pa.binary())], ["_g", "rep", "cell", "n", "pos", "data"])

    return rows.mapInArrow(run, "_g bigint, rep bigint, cell bigint, n bigint, pos bigint, data binary")


def _cell_sums(dealt: DataFrame) -> DataFrame:
    """``_g, rep`` and the sums of every range of scores: ``tp, called, n, pos, area``; ``_pos, _above, _hits`` count the whole replica and what lies above the range."""

    def sums(n_pos: int, above: int, hits: int, parts: list[tuple[bytes, int]]) -> tuple:
        sides = [_unpacked(*p) for p in parts]
        key, hit = np.concatenate([k for k, _ in sides]), np.concatenate([h for _, h in sides])
        order = np.argsort(key)[::-1]
        key, hit = key[order], hit[order]
        last = np.flatnonzero(np.r_[key[1:] != key[:-1], True])  # equal scores are one step
        called = int((key > _sortable(np.array([0.5]))[0]).sum())
        tp = int(hit[:called].sum())
        found = np.cumsum(hit)[last]
        precision = (hits + found) / (above + last + 1.0)
        before = 1.0 if above == 0 else hits / above
        if n_pos:
            width = np.diff(found, prepend=0) / n_pos
        else:
            width = np.r_[1.0 if above == 0 else 0.0, np.zeros(len(last) - 1)]
        area = float((width * (precision + np.r_[before, precision[:-1]]) / 2).sum())
        return tp, called, len(hit), int(hit.sum()), area

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, parts = None, None, []

        def result() -> pa.RecordBatch:
            values = [*name[:2], *sums(*held, parts)]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.float64() if k == 6 else pa.int64()) for k, v in enumerate(values)], ["_g", "rep", "tp", "called", "n", "pos", "area"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != name:
                    if parts:
                        yield result()
                    name, held, parts = row[:3], row[5:8], []
                parts.append((row[4], row[3]))
        if parts:
            yield result()

    keys = ["_g", "rep", "cell"]
    sorted_in_tasks = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_in_tasks.select(*keys, "n", "data", "_pos", "_above", "_hits").mapInArrow(
        run, "_g bigint, rep bigint, tp bigint, called bigint, n bigint, pos bigint, area double"
    )


def _dealt_metrics(rows: DataFrame, n_rows: int, n_mc: int, seed: int, cell_rows: int) -> DataFrame:
    """Like :func:`_replica_metrics` for more rows than may travel: ``_g, rep`` and the metrics.

    Every task draws all replicas of its own rows and sends the sorted scores once, packed;
    the scores of a group and replica meet in ranges of some ``cell_rows``. With several
    ranges, a first pass counts what lies above each.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22)
    cells = -(-n_rows // cell_rows)
    edges = sorted(set(rows.approxQuantile("_p", [k / cells for k in range(1, cells)], 0.01))) if cells > 1 else []
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = stage(rows.repartition(parts, "_id"), "noise-rows")
    dealt = _dealt_scores(rows, n_mc, seed, edges, True)
    if edges:
        counts = stage(_dealt_scores(rows, n_mc, seed, edges, False).groupBy("_g", "rep", "cell").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")), "cells")
        each = Window.partitionBy("_g", "rep")  # as many rows as there are ranges
        higher = each.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
        total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
        above = counts.select("_g", "rep", "cell", total("pos", each).alias("_pos"), total("n", higher).alias("_above"), total("pos", higher).alias("_hits"))
        dealt = dealt.drop("pos").join(above, ["_g", "rep", "cell"])
        sums = _cell_sums(dealt)
    else:
        hits = rows.groupBy("_g").agg(F.count_if(F.col("_y") == 1).alias("_pos"))
        sums = _cell_sums(dealt.drop("pos").join(hits, "_g").withColumns({"_above": F.lit(0).cast("bigint"), "_hits": F.lit(0).cast("bigint")}))
    whole = sums.groupBy("_g", "rep").agg(*(F.sum(c).alias(c) for c in ("tp", "called", "n", "pos", "area")))
    tp, n = F.col("tp"), F.col("n")
    fp, fn = F.col("called") - tp, F.col("pos") - tp
    counted = whole.select("_g", "rep", tp, fp.alias("fp"), fn.alias("fn"), (n - tp - fp - fn).alias("tn"), F.col("area").alias("pr_auc"))
    return counted.select(*_counts_to_metrics(["_g", "rep"]), "pr_auc")


def classification_sigma(
    df: DataFrame,
    row_id: str,
    keys: Sequence[str],
    n_mc: int = 1000,
    seed: int = 7,
    true: str = "target",
    pred: str = "pred",
    sigma: str = "sigma",
    limit: int = REPLICA_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Population deviation of the five metrics over noisy replicas.

    Up to ``limit`` rows go to the tasks, each of which makes some replicas of all of
    them and returns one row per group and replica, so no replica of a row is ever
    shuffled. Of more rows every task draws the replicas of its own, and the sorted
    scores are shuffled once, packed; the result is the same.
    """
    keys = list(keys)
    chosen = df.select(*keys, row_id, true, pred, sigma)
    if not 0 < chosen.limit(limit + 1).count() <= limit:
        values = [F.col(c).cast(t).alias(n) for c, t, n in ((row_id, "string", "_id"), (true, "bigint", "_y"), (pred, "double", "_p"), (sigma, "double", "_s"))]
        fixed = stage(df.select(*keys, *values), "replica-rows")
        named = stage(ordinal(fixed.select(*keys).distinct(), [F.col(k) for k in keys], name="_g"), "groups") if keys else None
        placed = match_keys(fixed, named, keys) if keys else fixed.withColumn("_g", F.lit(0))
        rows = placed.select(F.col("_g").cast("bigint").alias("_g"), "_id", "_y", "_p", "_s")
        per_rep = _dealt_metrics(rows, fixed.count(), n_mc, seed, cell_rows)
        spread = per_rep.groupBy("_g").agg(*[F.stddev_pop(m).alias(f"{m}_sigma") for m in CLASSIFICATION])
        return named.join(spread, "_g").drop("_g") if keys else spread.drop("_g")
    rows = chosen.select(
        F.struct(*keys).alias("_k") if keys else F.lit(0).alias("_k"), F.col(row_id).cast("string").alias("_id"),
        F.col(true).cast("bigint").alias("_y"), F.col(pred).cast("double").alias("_p"), F.col(sigma).cast("double").alias("_s"),
    ).toArrow()
    codes = rows["_k"].combine_chunks()
    names = codes.to_pylist()
    known = {repr(k): k for k in names}
    numbers = {text: i for i, text in enumerate(known)}
    table = rows.drop_columns("_k").append_column("_g", pa.array([numbers[repr(k)] for k in names], pa.int64()))
    per_rep = _replica_metrics(table, df.sparkSession, n_mc, seed)
    spread = per_rep.groupBy("_g").agg(*[F.stddev_pop(m).alias(f"{m}_sigma") for m in CLASSIFICATION])
    if not keys:
        return spread.drop("_g") if known else spread.drop("_g").limit(0)
    kinds = ", ".join(f"`{k}` {chosen.schema[k].dataType.simpleString()}" for k in keys)
    listed = df.sparkSession.createDataFrame([(numbers[t], *k.values()) for t, k in known.items()], f"_g bigint, {kinds}")
    return listed.join(spread, "_g").drop("_g")


def metrics_long(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``keys, metric, mean, sigma`` from a wide table with optional ``*_sigma``."""
    has = set(wide.columns)
    entries = F.array(*[
        F.struct(
            F.lit(m).alias("metric"),
            F.col(m).cast("double").alias("mean"),
            (F.col(f"{m}_sigma") if f"{m}_sigma" in has else F.lit(None)).cast("double").alias("sigma"),
        )
        for m in metrics
    ])
    return wide.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")


def score_table(long: DataFrame, key: str = "fold", sets: Sequence[str] = ("train", "valid", "test"), metrics: Sequence[str] = tuple(REGRESSION)) -> DataFrame:
    """Wide scores, one row per fold, columns ``set_metric_mean`` and ``..._sigma``."""
    cell = lambda s, m, stat: F.max(
        F.when((F.col("set") == s) & (F.col("metric") == m), F.col(stat))
    ).alias(f"{s}_{m}_{stat}")
    return long.groupBy(key).agg(
        *[cell(s, m, stat) for s in sets for m in metrics for stat in ("mean", "sigma")]
    )
