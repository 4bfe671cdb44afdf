"""Keyed operators over null keys, groups without spread and values that are no numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from molspark.catalog.base import digest, query, r6, table
from molspark.operators import metrics, scaling, selection, splits, tuning
from molspark.operators.rank import ordinal

_PRIORITY = "nullif(o_orderpriority, '1-URGENT')"
_FOLD = "nullif(o_orderkey % 4, 2)"


def _orders(spark, sf, *columns):
    return table(spark, sf, "orders").selectExpr("o_orderkey", f"{_PRIORITY} AS priority", f"{_FOLD} AS fold", *columns)


@query("win1_ordinal_null_keys", f"""SELECT o_orderkey, row_number() OVER (PARTITION BY {_PRIORITY} ORDER BY o_totalprice, o_orderkey) - 1 AS ordinal FROM orders""")
def _(spark, sf):
    rows = _orders(spark, sf, "o_totalprice")
    return ordinal(rows, [F.col("o_totalprice"), F.col("o_orderkey")], ["priority"]).select("o_orderkey", "ordinal")


@query("win2_group_numbers_null_group", f"SELECT o_orderkey, dense_rank() OVER (ORDER BY {_PRIORITY} NULLS FIRST) - 1 AS group_no FROM orders")
def _(spark, sf):
    return splits.group_numbers(_orders(spark, sf), "priority").select("o_orderkey", "group_no")


@query("win3_group_kfold_null_group", f"""WITH g AS (SELECT {_PRIORITY} AS p, count(*) AS n FROM orders GROUP BY 1)
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_groups, 5::BIGINT AS n_folds FROM g""")
def _(spark, sf):
    folds = splits.group_kfold(_orders(spark, sf).select("priority"), "priority", 5)
    groups = folds.groupBy("priority").agg(F.count("*").alias("n"), F.count_distinct("fold").alias("folds"), F.min("fold").alias("fold")).where("folds = 1")
    return groups.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.count_distinct("fold").alias("n_folds"))


@query("win4_stratified_null_class", f"""WITH c AS (SELECT doc_id, nullif(quality, 0) AS q FROM labels),
r AS (SELECT doc_id, q, row_number() OVER (PARTITION BY q ORDER BY {digest(42, 'doc_id')}, doc_id) AS r FROM c),
p AS (SELECT q, (row_number() OVER (ORDER BY q NULLS FIRST) - 1) % 4 AS f FROM c),
n AS (SELECT q, f, row_number() OVER (PARTITION BY q ORDER BY f) AS r FROM p)
SELECT doc_id, f::INT AS fold FROM r JOIN n ON r.q IS NOT DISTINCT FROM n.q AND r.r = n.r""")
def _(spark, sf):
    rows = table(spark, sf, "labels").selectExpr("doc_id", "nullif(quality, 0) AS class")
    return splits.stratified_kfold(rows, "doc_id", "class", 4).select("doc_id", "fold")


@query("agg11_pr_auc_null_keys", f"""WITH s AS (SELECT {_FOLD} AS fold, (o_orderkey % 3 = 0)::INT AS target, (o_custkey * 7919) % 997 / 997.0::DOUBLE AS pred FROM orders),
l AS (SELECT fold, pred, sum(target) AS pos, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT fold, pred, sum(pos) OVER w AS tp, sum(n) OVER w AS taken, sum(pos) OVER (PARTITION BY fold) AS positives FROM l WINDOW w AS (PARTITION BY fold ORDER BY pred DESC)),
p AS (SELECT fold, pred, tp / taken AS precision, tp / positives AS recall FROM c),
a AS (SELECT fold, (recall - lag(recall, 1, 0) OVER w) * (precision + lag(precision, 1, 1) OVER w) / 2 AS area FROM p WINDOW w AS (PARTITION BY fold ORDER BY pred DESC))
SELECT fold, round(sum(area), 6) AS pr_auc FROM a GROUP BY fold""")
def _(spark, sf):
    rows = _orders(spark, sf, "int(o_orderkey % 3 = 0) AS target", "(o_custkey * 7919) % 997 / 997.0D AS pred")
    return metrics.pr_auc(metrics.pr_curve(rows, ["fold"]), ["fold"]).select("fold", r6(F.col("pr_auc"), "pr_auc"))


@query("agg24_robust_fit_null_fold", f"""SELECT {_FOLD} AS fold, round(quantile_cont(o_totalprice, 0.5), 6) AS center,
round(quantile_cont(o_totalprice, 0.95) - quantile_cont(o_totalprice, 0.05), 6) AS scale FROM orders GROUP BY 1""")
def _(spark, sf):
    fitted = scaling.fit_robust(_orders(spark, sf, "o_totalprice"), "o_totalprice")
    return fitted.select("fold", r6(F.col("center"), "center"), r6(F.col("scale"), "scale"))


@query("scl17_min_max_null_keys", f"""SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w), 6) AS norm
FROM orders WINDOW w AS (PARTITION BY {_PRIORITY})""")
def _(spark, sf):
    out = scaling.min_max(_orders(spark, sf, "o_totalprice"), "o_totalprice", "norm", ["priority"])
    return out.select("o_orderkey", r6(F.col("norm"), "norm"))




# fold 0 has a constant target, fold 1 perfect predictions
@query("agg8_regression_degenerate", f"""WITH p AS (SELECT {_FOLD} AS fold, CASE WHEN o_orderkey % 4 = 0 THEN 3.5 ELSE CAST(o_custkey % 101 AS DOUBLE) END AS target,
 o_custkey % 103 AS other, o_orderkey % 4 AS k, (o_orderkey % 7) / 7.0::DOUBLE AS sigma FROM orders),
q AS (SELECT fold, target, CASE WHEN k = 1 THEN target ELSE other END AS mean, sigma FROM p),
s AS (SELECT fold, count(*) AS n, sum((target - mean) ** 2) AS res, CASE WHEN min(target) = max(target) THEN 0 ELSE var_pop(target) * count(*) END AS tot,
 sum((target - mean) ** 2 * sigma ** 2) AS w FROM q GROUP BY 1)
SELECT fold, round(sqrt(res / n), 6) AS rmse, CASE WHEN tot = 0 THEN NULL ELSE round(1 - res / tot, 6) END AS r2,
 CASE WHEN res = 0 THEN 0 ELSE round(sqrt(w / n / res), 6) END AS rmse_sigma, CASE WHEN tot = 0 THEN NULL ELSE round(2 * sqrt(w) / tot, 6) END AS r2_sigma FROM s""")
def _(spark, sf):
    rows = _orders(
        spark, sf, "CASE WHEN o_orderkey % 4 = 0 THEN 3.5D ELSE double(o_custkey % 101) END AS target",
        "o_custkey % 103 AS other", "o_orderkey % 4 AS k", "(o_orderkey % 7) / 7.0D AS sigma",
    ).withColumn("mean", F.expr("CASE WHEN k = 1 THEN target ELSE double(other) END"))
    out = metrics.regression_metrics(rows, ["fold"], sigma="sigma")
    return out.select("fold", *(r6(F.col(c), c) for c in ("rmse", "r2", "rmse_sigma", "r2_sigma")))


@query("agg9_classification_no_rows", "SELECT 0 AS fold, 0.0::DOUBLE AS accuracy, 0.0::DOUBLE AS f1 WHERE false")
def _(spark, sf):
    none = _orders(spark, sf, "0 AS target", "0.0D AS pred").where("o_orderkey < 0")
    return metrics.classification_metrics(none.withColumn("fold", F.col("fold").cast("int")), ["fold"]).select("fold", "accuracy", "f1")


@query("agg17_stability_constant_weight", """WITH r AS (SELECT l_returnflag AS config_id, l_linenumber AS weight, CASE WHEN l_linenumber = 2 THEN 5.0 ELSE l_extendedprice END AS pred FROM lineitem),
s AS (SELECT config_id, weight, CASE WHEN max(pred) OVER w = min(pred) OVER w THEN 0 ELSE (pred - min(pred) OVER w) / (max(pred) OVER w - min(pred) OVER w) END AS p
 FROM r WINDOW w AS (PARTITION BY config_id, weight)),
v AS (SELECT config_id, weight, CASE WHEN avg(p) = 0 THEN NULL ELSE stddev_pop(p) / avg(p) END AS r FROM s GROUP BY ALL)
SELECT config_id, round(stddev_pop(r) / avg(r), 6) AS score FROM v GROUP BY 1""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS config_id", "l_linenumber AS weight", "CASE WHEN l_linenumber = 2 THEN 5.0D ELSE double(l_extendedprice) END AS pred"
    )
    return tuning.stability_score(rows).withColumn("score", F.round("score", 6))


@query("srt1_top_fraction_nan", """WITH v AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0)
SELECT o_orderkey FROM v ORDER BY o_totalprice DESC, o_orderkey LIMIT (SELECT ceil(count(*) * 0.2)::BIGINT FROM v)""")
def _(spark, sf):
    value = "CASE WHEN o_orderkey % 7 <> 0 THEN double(o_totalprice) WHEN o_orderkey % 2 = 0 THEN double('NaN') END AS value"
    return selection.top_fraction(_orders(spark, sf, value), "value", "o_orderkey", 0.2).select("o_orderkey")


@query("srt2_top_and_bottom_nan", """WITH v AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0)
(SELECT o_orderkey, 'top' AS "end" FROM v ORDER BY o_totalprice DESC, o_orderkey LIMIT 6)
UNION ALL (SELECT o_orderkey, 'bottom' FROM v ORDER BY o_totalprice, o_orderkey DESC LIMIT 6)""")
def _(spark, sf):
    value = "CASE WHEN o_orderkey % 7 <> 0 THEN double(o_totalprice) WHEN o_orderkey % 2 = 0 THEN double('NaN') END AS value"
    return selection.top_and_bottom(_orders(spark, sf, value), "value", "o_orderkey", 6, 6).select("o_orderkey", "end")
