"""Metrics, curves, histograms and score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from molspark.catalog.base import query, r6, table
from molspark.functions.scores import display_precision
from molspark.operators import metrics, similarity
from molspark.plans import cross_validation as cv

REGRESSION_SQL = """preds AS (SELECT o_orderkey AS row_id, (o_orderkey % 3)::INT AS fold,
 CASE WHEN o_custkey % 10 < 6 THEN 'train' WHEN o_custkey % 10 < 8 THEN 'valid' ELSE 'test' END AS set,
 o_totalprice / 100000 AS target, o_totalprice / 100000 + ((o_custkey % 21) - 10) / 20.0::DOUBLE AS mean,
 0.1::DOUBLE + (o_orderkey % 5) / 50.0::DOUBLE AS sigma FROM orders)"""


def regression_preds(spark, sf):
    """A deterministic prediction table over orders."""
    cust = F.col("o_custkey")
    true = F.col("o_totalprice") / 100000
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_orderkey") % 3).cast("int").alias("fold"),
        F.when(cust % 10 < 6, "train").when(cust % 10 < 8, "valid").otherwise("test").alias("set"),
        true.alias("target"),
        (true + (cust % 21 - 10) / 20.0).alias("mean"),
        (0.1 + (F.col("o_orderkey") % 5) / 50.0).alias("sigma"),
    )


CLASSES_SQL = """scored AS (SELECT doc_id, (doc_id % 3)::INT AS fold, quality AS target,
 (n_chars % 97) / 97.0::DOUBLE AS pred, 0.05::DOUBLE + (doc_id % 7) / 100.0::DOUBLE AS sigma
 FROM labels JOIN documents USING (doc_id))"""


def class_preds(spark, sf):
    """Labels with a deterministic score from the document length."""
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", (F.col("doc_id") % 3).cast("int").alias("fold"), F.col("quality").alias("target"),
        (F.col("n_chars") % 97 / 97.0).alias("pred"), (0.05 + F.col("doc_id") % 7 / 100.0).alias("sigma"),
    )


_REG = """round(sqrt(sum((target - mean) ** 2) / count(*)), 6) AS rmse, round(avg(abs(target - mean)), 6) AS mae,
 round(1 - sum((target - mean) ** 2) / (var_pop(target) * count(*)), 6) AS r2"""
_REG_SIGMA = """round(sqrt(sum((target - mean) ** 2 * sigma ** 2) / count(*) / sum((target - mean) ** 2)), 6) AS rmse_sigma,
 round(sqrt(sum(sigma ** 2)) / count(*), 6) AS mae_sigma,
 round(2 / (var_pop(target) * count(*)) * sqrt(sum((target - mean) ** 2 * sigma ** 2)), 6) AS r2_sigma"""


@query("agg7_regression_metrics", f"WITH {REGRESSION_SQL} SELECT fold, set, {_REG} FROM preds GROUP BY fold, set")
def _(spark, sf):
    out = metrics.regression_metrics(regression_preds(spark, sf), ["fold", "set"])
    return out.select("fold", "set", *[r6(F.col(c), c) for c in metrics.REGRESSION])


@query("agg8_regression_sigma", f"WITH {REGRESSION_SQL} SELECT fold, set, {_REG_SIGMA} FROM preds GROUP BY fold, set")
def _(spark, sf):
    out = metrics.regression_metrics(regression_preds(spark, sf), ["fold", "set"], sigma="sigma")
    return out.select("fold", "set", *[r6(F.col(f"{c}_sigma"), f"{c}_sigma") for c in metrics.REGRESSION])


_COUNTS = """counts AS (SELECT fold, count(*) FILTER (target = 1 AND pred > 0.5) AS tp, count(*) FILTER (target = 0 AND pred > 0.5) AS fp,
 count(*) FILTER (target = 1 AND pred <= 0.5) AS fn, count(*) FILTER (target = 0 AND pred <= 0.5) AS tn FROM scored GROUP BY fold)"""


@query("agg9_classification_metrics", f"""WITH {CLASSES_SQL}, {_COUNTS} SELECT fold, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM counts""")
def _(spark, sf):
    out = metrics.classification_metrics(class_preds(spark, sf), ["fold"])
    return out.select("fold", *[r6(F.col(c), c) for c in metrics.CLASSIFICATION[:4]])


@query("agg10_confusion_matrix", f"""WITH {CLASSES_SQL} SELECT target, count(*) FILTER (pred <= 0.5) AS pred_0, count(*) FILTER (pred > 0.5) AS pred_1 FROM scored GROUP BY target""")
def _(spark, sf):
    return metrics.confusion_matrix(class_preds(spark, sf))


_CURVE = """levels AS (SELECT fold, pred AS threshold, sum(target) AS pos, count(*) AS c FROM scored GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(c) OVER w AS taken, sum(pos) OVER (PARTITION BY fold) AS positives FROM levels
 WINDOW w AS (PARTITION BY fold ORDER BY threshold DESC)),
curve AS (SELECT fold, threshold, tp, taken, pos, c, positives, tp / taken AS precision, tp / positives AS recall FROM cum)"""


@query("agg11_pr_curve", f"""WITH {CLASSES_SQL}, {_CURVE} SELECT fold, round(threshold, 6) AS threshold, round(precision, 6) AS precision,
round(recall, 6) AS recall FROM curve""")
def _(spark, sf):
    curve = metrics.pr_curve(class_preds(spark, sf), ["fold"])
    return curve.select("fold", *[r6(F.col(c), c) for c in ("threshold", "precision", "recall")])


@query("agg11_pr_curve_all", f"""WITH {CLASSES_SQL.replace('(doc_id % 3)::INT', '0')}, {_CURVE} SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision,
round(recall, 6) AS recall FROM curve""")
def _(spark, sf):
    curve = metrics.pr_curve(class_preds(spark, sf), [])
    return curve.select(*[r6(F.col(c), c) for c in ("threshold", "precision", "recall")])


_AUC = """points AS (SELECT *, lag(recall, 1, 0) OVER w AS r0, lag(precision, 1, 1) OVER w AS p0 FROM curve
 WINDOW w AS (PARTITION BY fold ORDER BY threshold DESC)),
area AS (SELECT fold, sum((recall - r0) * (precision + p0) / 2) AS pr_auc FROM points GROUP BY fold)"""


@query("agg11_pr_auc", f"WITH {CLASSES_SQL}, {_CURVE}, {_AUC} SELECT fold, round(pr_auc, 6) AS pr_auc FROM area")
def _(spark, sf):
    curve = metrics.pr_curve(class_preds(spark, sf), ["fold"])
    return metrics.pr_auc(curve, ["fold"]).select("fold", r6(F.col("pr_auc"), "pr_auc"))


@query("agg12_best_threshold", f"""WITH {CLASSES_SQL}, {_CURVE}, f AS (SELECT fold, threshold, CASE WHEN precision + recall > 0 THEN
2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM curve),
b AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, threshold) AS k FROM f),
p AS (SELECT fold, avg(target::DOUBLE) AS share FROM scored GROUP BY fold)
SELECT fold, round(threshold, 6) AS threshold, round(f1, 6) AS f1, round(share, 6) AS random_precision FROM b JOIN p USING (fold) WHERE k = 1""")
def _(spark, sf):
    preds = class_preds(spark, sf)
    best = metrics.best_threshold(metrics.pr_curve(preds, ["fold"]), ["fold"])
    both = best.join(metrics.positive_share(preds, ["fold"]), "fold")
    return both.select("fold", *[r6(F.col(c), c) for c in ("threshold", "f1", "random_precision")])


def _noise(seed: int) -> str:
    d = f"md5('{seed}|' || doc_id || '|' || rep)"
    u1 = f"((CAST('0x' || substr({d}, 1, 8) AS BIGINT) + 1) / 4294967297.0::DOUBLE)"
    u2 = f"(CAST('0x' || substr({d}, 9, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
    return f"sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2})"


N_MC = 1000


@query("agg13_monte_carlo_sigma", f"""WITH {CLASSES_SQL.replace('scored AS', 'base AS')},
scored AS (SELECT rep AS fold, target, pred + {_noise(7)} * sigma AS pred FROM (SELECT *, unnest(range({N_MC})) AS rep FROM base)),
{_COUNTS}, {_CURVE}, {_AUC},
m AS (SELECT (tp + tn) / (tp + tn + fp + fn) AS a, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p,
 CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f, pr_auc
 FROM counts JOIN area USING (fold))
SELECT round(stddev_pop(a), 6) AS accuracy_sigma, round(stddev_pop(p), 6) AS precision_sigma, round(stddev_pop(r), 6) AS recall_sigma,
round(stddev_pop(f), 6) AS f1_sigma, round(stddev_pop(pr_auc), 6) AS pr_auc_sigma FROM m""")
def _(spark, sf):
    out = metrics.classification_sigma(class_preds(spark, sf), "doc_id", [], N_MC, seed=7)
    return out.select(*[r6(F.col(f"{m}_sigma"), f"{m}_sigma") for m in metrics.CLASSIFICATION])


_LONG = f"""wide AS (SELECT fold, set, {_REG}, {_REG_SIGMA} FROM preds GROUP BY fold, set),
long AS (SELECT fold, set, 'rmse' AS metric, rmse AS mean, rmse_sigma AS sigma FROM wide UNION ALL SELECT fold, set, 'mae', mae, mae_sigma FROM wide
 UNION ALL SELECT fold, set, 'r2', r2, r2_sigma FROM wide)"""


@query("agg22_fold_scores", f"WITH {REGRESSION_SQL}, {_LONG} SELECT fold, " + ", ".join(
    f"max({stat}) FILTER (set = '{s}' AND metric = '{m}') AS {s}_{m}_{stat}"
    for s in ("train", "valid", "test") for m in metrics.REGRESSION for stat in ("mean", "sigma")
) + " FROM long GROUP BY fold")
def _(spark, sf):
    wide = metrics.regression_metrics(regression_preds(spark, sf), ["fold", "set"], sigma="sigma")
    out = metrics.score_table(metrics.metrics_long(wide, ["fold", "set"], metrics.REGRESSION))
    return out.select("fold", *[r6(F.col(c), c) for c in out.columns[1:]])


@query("ml3_final_scores", f"""WITH {REGRESSION_SQL}, t AS (SELECT * FROM preds WHERE set = 'test' AND row_id % 11 <> 0) SELECT
{', '.join(f"round({m}, 6) AS final_{m}_mean, round({m}_sigma, 6) AS final_{m}_sigma" for m in metrics.REGRESSION)}
FROM (SELECT {_REG}, {_REG_SIGMA} FROM t)""")
def _(spark, sf):
    hole = F.col("row_id") % 11 == 0
    oof = regression_preds(spark, sf).select(
        "row_id", "fold", F.col("set").alias("split"), "target",
        F.when(~hole, F.col("mean")).alias("mean"), "sigma",
    )
    out = cv.final_scores(cv.evaluate(oof))
    return out.select(*[r6(F.col(c), c) for c in out.columns])


@query("scl11_metric_format", f"""WITH {REGRESSION_SQL} SELECT fold, CASE WHEN log10(rmse) > 0 THEN '1.' || (3 - floor(log10(rmse)))::INT ELSE '0.' || (abs(floor(log10(rmse))) + 3)::INT END AS fmt
FROM (SELECT fold, sqrt(avg((target - mean) ** 2)) AS rmse FROM preds GROUP BY fold)""")
def _(spark, sf):
    out = metrics.regression_metrics(regression_preds(spark, sf), ["fold"])
    return out.select("fold", display_precision(F.col("rmse"), 4).alias("fmt"))


@query("agg21_histogram", """WITH s AS (SELECT l_returnflag AS series, l_extendedprice AS x FROM lineitem),
e AS (SELECT series, min(x) AS a, (max(x) - min(x)) / 50 AS step, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT series, least(floor((x - a) / step), 49)::INT AS bin, count(*) AS c FROM s JOIN e USING (series) GROUP BY ALL),
f AS (SELECT *, unnest(range(50))::INT AS bin FROM e)
SELECT series, bin, round(a + bin * step, 6) AS lo, round(a + (bin + 1) * step, 6) AS hi, round(coalesce(c, 0) / (n * step), 12) AS density
FROM f LEFT JOIN c USING (series, bin)""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series"), F.col("l_extendedprice").alias("x"))
    out = similarity.density_histogram(rows, "x")
    return out.select("series", "bin", r6(F.col("lo"), "lo"), r6(F.col("hi"), "hi"), F.round("density", 12).alias("density"))
