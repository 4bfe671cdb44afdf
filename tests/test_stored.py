"""Saved ensembles against the fitted models they come from."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from molspark.operators import scaling
from molspark.plans import cross_validation as cv, stored
from molspark.staging import fresh_path


@pytest.fixture(scope="module")
def rows(spark):
    parts = ["CCO", "CCN", "c1ccccc1", "CC(=O)O", "CCCl", "NCCO"]
    rnd = random.Random(2)
    data = [(i, parts[i % 6] + parts[(i * 5) % 4] * (i % 3), rnd.random() * 5, float(i % 7)) for i in range(150)]
    df = spark.createDataFrame(data, "id long, smiles string, x double, z double")
    return df.withColumn("y", F.length("smiles") + F.col("x")).withColumn("c", (F.length("smiles") > 5).cast("int"))


def close(a, b):
    left, right = ({r["id"]: r for r in t.collect()} for t in (a, b))
    assert left.keys() == right.keys()
    for k in left:
        for c in ("mean", "sigma"):
            assert (left[k][c] is None) == (right[k][c] is None)
            if left[k][c] is not None:
                assert left[k][c] == pytest.approx(right[k][c], abs=1e-6)


@pytest.mark.parametrize("kind, extras", [("regression", []), ("regression", ["x", "z"]), ("classification", [])])
def test_loaded_members_predict_like_the_fitted_ones(spark, rows, kind, extras):
    data = cv.prepare(rows, "id", "smiles", "y" if kind == "regression" else "c", k=3, n_features=32, kind=kind, extras=extras)
    model = cv.train_ensemble(data, n_runs=2)
    folder = fresh_path(spark, "ensemble")
    stored.save(stored.member_table(model), folder)
    known = stored.manifest(spark, folder)
    assert (known.kind, known.n_features, known.n_folds, known.n_runs, known.n_members) == (kind, 32, 3, 2, 6)
    assert known.has_extra == bool(extras) and known.scale_output == (kind == "regression")
    odd = rows.select("id", "smiles", "x", "z").unionByName(spark.createDataFrame([(900, None, 1.0, None), (901, "", None, 1.0)], "id long, smiles string, x double, z double"))
    close(stored.load(spark, folder).infer(odd, "smiles", "id", extras=extras), model.infer(odd, "smiles", "id", extras=extras))


def test_a_part_is_loaded_without_the_rest(spark, rows):
    data = cv.prepare(rows, "id", "smiles", "y", k=3, n_features=32)
    model = cv.train_ensemble(data, n_runs=2)
    folder = fresh_path(spark, "ensemble")
    stored.save(stored.member_table(model), folder)
    some = stored.load(spark, folder, folds=[0, 2], runs=[1])
    assert some.n_members == 2
    close(some.infer(rows, "smiles", "id"), cv.replace(model, members={m: v for m, v in model.members.items() if m in ((0, 1), (2, 1))}).infer(rows, "smiles", "id"))
    plan = spark.read.schema(stored.MEMBERS).parquet(f"{folder}/members").where(F.col("fold").isin([0, 2]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [fold" in plan
    with pytest.raises(ValueError, match="folds"):
        stored.load(spark, folder, folds=[7])


def test_members_in_parts_and_own_folds(spark, rows, monkeypatch):
    data = cv.prepare(rows, "id", "smiles", "y", k=3, n_features=32)
    model = cv.train_ensemble(data, n_runs=2)
    folder = fresh_path(spark, "ensemble")
    stored.save(stored.member_table(model), folder)
    whole = stored.load(spark, folder).infer(rows, "smiles", "id")
    monkeypatch.setattr(stored, "PART_VALUES", 64)
    loaded = stored.load(spark, folder)
    assert len(loaded._parts()) == 3
    close(loaded.infer(rows, "smiles", "id"), whole)
    folds = data.rows.select(F.col("row_id").alias("id"), F.col("text").alias("smiles"), "fold")
    preds = loaded.out_of_fold(folds, "smiles", "id")
    expected = cv.out_of_fold(model, data).where("split = 'test'").select(F.col("row_id").alias("id"), "mean", "sigma")
    close(preds.groupBy("id").agg(F.avg("pred").alias("mean"), F.stddev_pop("pred").alias("sigma")), expected)


def test_missing_extras_are_an_error(spark, rows):
    data = cv.prepare(rows, "id", "smiles", "y", k=2, n_features=16, extras=["x"])
    folder = fresh_path(spark, "ensemble")
    stored.save(stored.member_table(cv.train_ensemble(data, n_runs=1)), folder)
    with pytest.raises(ValueError, match="extra"):
        stored.load(spark, folder).infer(rows, "smiles", "id")


def test_classifier_scores_per_run(rows):
    data = cv.prepare(rows, "id", "smiles", "c", k=2, n_features=32, kind="classification")
    found = cv.run_scores(cv.train_ensemble(data, n_runs=2), data).collect()
    assert {(r.fold, r.run, r.set) for r in found} == {(f, r, s) for f in (0, 1) for r in (0, 1) for s in ("train", "valid", "test")}
    assert all(0 <= r[c] <= 1 for r in found for c in ("accuracy", "precision", "recall", "f1", "pr_auc"))


def test_many_columns_at_once(spark):
    rnd = np.random.default_rng(3)
    names = [f"c{i}" for i in range(12)]
    data = [(int(i % 3), *map(float, rnd.normal(size=11)), None if i % 2 else float(i)) for i in range(600)]
    df = spark.createDataFrame(data, "fold int, " + ", ".join(f"{n} double" for n in names))
    got = {(r.fold, r["column"]): (r.center, r.scale) for r in scaling.fit_robust_columns(df, names).collect()}
    assert len(got) == 36
    for (fold, name), (center, scale) in got.items():
        values = [r[1 + names.index(name)] for r in data if r[0] == fold and r[1 + names.index(name)] is not None]
        low, middle, high = np.quantile(values, [0.05, 0.5, 0.95])
        assert center == pytest.approx(middle) and scale == pytest.approx(high - low)
