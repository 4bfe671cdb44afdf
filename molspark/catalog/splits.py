"""Folds, splits, scaling and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from molspark.catalog.base import heavy, digest, query, r6, table, uniform_sql
from molspark.catalog.scans import SCALER_SQL, fold_scaler
from molspark.operators import scaling, splits
from molspark.staging import stage


@query("win2_group_numbers", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS group_no FROM orders")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return splits.group_numbers(rows, "o_orderpriority").drop("o_orderpriority")


@query("win2_group_numbers_text", "SELECT doc_id, dense_rank() OVER (ORDER BY text) - 1 AS group_no FROM documents")
def _(spark, sf):
    rows = heavy(spark, sf, "documents").select("doc_id", "text")
    return splits.group_numbers(rows, "text").drop("text")


@query("win3_group_kfold_loads", """WITH RECURSIVE g AS (SELECT size, row_number() OVER (ORDER BY size DESC) AS i FROM
 (SELECT count(*) AS size FROM lineitem GROUP BY l_suppkey)),
step AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, [0, 0, 0, 0, 0]::BIGINT[] AS members
 UNION ALL SELECT g.i, list_transform(loads, lambda v, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN v + g.size ELSE v END),
 list_transform(members, lambda v, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN v + 1 ELSE v END)
 FROM step JOIN g ON g.i = step.i + 1),
last AS (SELECT loads, members FROM step ORDER BY i DESC LIMIT 1)
SELECT (unnest(range(5)))::INT AS fold, unnest(loads) AS n_rows, unnest(members) AS n_groups FROM last""")
def _(spark, sf):
    folds = splits.group_kfold(table(spark, sf, "lineitem").select("l_suppkey"), "l_suppkey", 5)
    return folds.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_suppkey").alias("n_groups")
    )


@query("win3_group_kfold_members")
def _(spark, sf):
    return splits.group_kfold(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 5)


@query("win4_stratified_kfold", f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {digest(42, 'doc_id')}, doc_id) AS r FROM labels),
p AS (SELECT quality, (row_number() OVER (ORDER BY quality) - 1) % 4 AS f FROM labels),
q AS (SELECT quality, f, row_number() OVER (PARTITION BY quality ORDER BY f) AS r FROM p)
SELECT doc_id, r.quality, f::INT AS fold FROM r JOIN q ON r.quality = q.quality AND r.r = q.r""")
def _(spark, sf):
    return splits.stratified_kfold(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality", 4)


@query("win5_shuffled_kfold", f"SELECT o_orderkey, (ntile(7) OVER (ORDER BY {digest(123, 'o_orderkey')}, o_orderkey) - 1)::INT AS fold FROM orders")
def _(spark, sf):
    return splits.shuffled_kfold(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7)


_CV = f"""hashed AS (SELECT o_orderkey, row_number() OVER (ORDER BY {digest(42, 'o_orderkey')}, o_orderkey) AS h FROM orders),
each AS (SELECT o_orderkey, h, o_orderkey % 5 AS own, unnest([0, 1, 2, 3, 4]) AS fold FROM hashed),
r AS (SELECT o_orderkey, fold, row_number() OVER (PARTITION BY fold ORDER BY h) AS r,
 count(*) OVER (PARTITION BY fold) AS n FROM each WHERE own <> fold),
cv AS (SELECT o_orderkey, fold, CASE WHEN r <= ceil(n * 6 / 9::DOUBLE) THEN 'train' ELSE 'valid' END AS split FROM r
 UNION ALL SELECT o_orderkey, fold, 'test' FROM each WHERE own = fold)"""


def _cv(spark, sf, **kw):
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("fold"))
    return splits.cross_validation_splits(rows, "o_orderkey", 5, **kw)


@query("win6_train_valid_test", f"WITH {_CV} SELECT o_orderkey, fold::INT AS fold, split FROM cv")
def _(spark, sf):
    return _cv(spark, sf)


@query("win6_train_valid_only", f"WITH {_CV} SELECT o_orderkey, fold::INT AS fold, split FROM cv WHERE split <> 'test'")
def _(spark, sf):
    return _cv(spark, sf, keep_test=False)


@query("agg23_split_shares", f"""WITH {_CV} SELECT fold::INT AS fold, round(count(*) FILTER (split = 'train') / count(*), 6) AS train_share,
round(count(*) FILTER (split = 'valid') / count(*), 6) AS valid_share, round(count(*) FILTER (split = 'test') / count(*), 6) AS test_share FROM cv GROUP BY 1""")
def _(spark, sf):
    shares = splits.split_shares(_cv(spark, sf))
    return shares.select("fold", *[r6(F.col(c), c) for c in ("train_share", "valid_share", "test_share")])


@query("win7_floor_split", f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {digest(42, 'doc_id')}, doc_id) <= floor((SELECT count(*) FROM documents) * 0.8::DOUBLE)
THEN 'train' ELSE 'valid' END AS split FROM documents""")
def _(spark, sf):
    return splits.train_valid(heavy(spark, sf, "documents").select("doc_id"), "doc_id", share="floor_0_8")


@query("set6_resample", f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no FROM orders),
d AS (SELECT range AS draw, floor({uniform_sql(21, 'range')} * (SELECT count(*) FROM orders))::BIGINT AS row_no FROM range(2000))
SELECT draw, row_no, o_orderkey FROM d JOIN r USING (row_no)""")
def _(spark, sf):
    return splits.resample(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 2000)


@query("agg24_robust_fit", f"WITH {SCALER_SQL} SELECT fold, round(center, 6) AS center, round(scale, 6) AS scale FROM scaler")
def _(spark, sf):
    return fold_scaler(spark, sf).select("fold", r6(F.col("center"), "center"), r6(F.col("scale"), "scale"))


@query("agg24_robust_fit_columns", " UNION ALL ".join(f"""SELECT (l_orderkey % 5)::INT AS fold, '{c}' AS "column", round(quantile_cont({c}::DOUBLE, 0.5), 6) AS center,
 round(CASE WHEN quantile_cont({c}::DOUBLE, 0.95) = quantile_cont({c}::DOUBLE, 0.05) THEN 1 ELSE quantile_cont({c}::DOUBLE, 0.95) - quantile_cont({c}::DOUBLE, 0.05) END, 6) AS scale
 FROM lineitem GROUP BY 1""" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey")))
def _(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 5).cast("int").alias("fold"), *columns)
    return scaling.fit_robust_columns(rows, columns).select("fold", "column", r6(F.col("center"), "center"), r6(F.col("scale"), "scale"))


_ROWS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("win9_scale_and_back", f"""WITH {SCALER_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
round((l_extendedprice - center) / scale, 6) AS scaled, round(l_extendedprice, 4) AS back
FROM lineitem JOIN scaler ON fold = l_orderkey % 5""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(*_ROWS, (F.col("l_orderkey") % 5).cast("int").alias("fold"), "l_extendedprice")
    scaler = stage(fold_scaler(spark, sf), "scaler")
    there = scaling.transform(rows, scaler, "l_extendedprice", "s")
    back = scaling.inverse_transform(there, scaler, "s", "b")
    return back.select(*_ROWS, r6(F.col("s"), "scaled"), F.round("b", 4).alias("back"))


@query("scl17_min_max", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN max(l_tax) OVER w = min(l_tax) OVER w THEN 0 ELSE
(l_tax - min(l_tax) OVER w) / (max(l_tax) OVER w - min(l_tax) OVER w) END, 6) AS norm FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(*_ROWS, "l_tax")
    return scaling.min_max(rows, "l_tax", "norm", ["l_suppkey"]).select(*_ROWS, r6(F.col("norm"), "norm"))
