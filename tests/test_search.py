"""The search plan and its steps against plain loops."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from molspark.operators import tuning
from molspark.plans import cross_validation as cv, search


def table(spark, n_configs, n_weights, n_samples, seed=1):
    rnd = random.Random(seed)
    rows = [(c, float(w), s * s * 10, float(rnd.randrange(40))) for c in range(n_configs) for w in range(n_weights) for s in range(n_samples)]
    return spark.createDataFrame(rows, "config_id long, weight double, sample_id long, pred double"), rows


def test_weights_of_many_configurations_at_once(spark):
    df, rows = table(spark, 4, 7, 50)
    got = {}
    for r in tuning.least_correlated_by(df, "config_id", keep=4).collect():
        got.setdefault(r.config_id, {})[r.weight] = r.max_corr
    for config in range(4):
        single = tuning.least_correlated_weights(df.where(F.col("config_id") == config), keep=4).collect()
        assert got[config].keys() == {r.weight for r in single}
        for r in single:
            assert got[config][r.weight] == pytest.approx(r.max_corr)


def test_grid_rows_follow_from_their_number(spark):
    bounds = {"a": ["x", "y"], "b": [1, 2, 3], "c": [0.5]}
    assert sorted(map(tuple, tuning.parameter_grid(spark, bounds).collect())) == sorted(itertools.product(*bounds.values()))
    assert tuning.parameter_grid(spark, {"a": [], "b": [1]}).count() == 0
    large = tuning.parameter_grid(spark, {k: list(range(20)) for k in "abcd"})
    assert large.distinct().count() == 160_000 and large.rdd.getNumPartitions() > 1


def test_crossed_values_leave_nulls_out(spark):
    a, b = spark.createDataFrame([(1,), (1,), (None,)], "v long"), spark.createDataFrame([("p",), ("q",)], "w string")
    assert sorted(map(tuple, tuning.crossed_values({"x": a, "y": b}).collect())) == [(1, "p"), (1, "q")]


def test_plan_runs_its_steps_in_turn(spark):
    calls = []

    def score(configs, weights):
        calls.append((configs.count(), weights.count()))
        samples = spark.range(40).withColumnRenamed("id", "sample_id")
        wide = samples.crossJoin(configs.select("config_id", "p")).crossJoin(weights)
        return wide.withColumn("pred", F.pmod(F.xxhash64("sample_id", "p", "weight"), F.lit(1000)).cast("double") + F.col("p"))

    grid = tuning.parameter_grid(spark, {"p": [1, 2, 3], "q": ["u", "v"], "r": [True, False]})
    scores, weights = search.stable_configurations(grid, score, weights=[1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], n_draws=5, keep=4)
    found, common = scores.collect(), weights.collect()
    assert calls == [(5, 8), (12, len(common))] and 1 <= len(common) <= 5
    assert len(found) == 12 and all(r.score is not None for r in found)
    by_p = {r.p: r.score for r in found}
    assert all(r.score == pytest.approx(by_p[r.p]) for r in found)  # q and r have no effect here


def test_every_configuration_is_fitted_once(spark, monkeypatch):
    rnd = np.random.default_rng(0)
    rows = [(i, "C" * int(rnd.integers(1, 9)) + "O" * int(rnd.integers(0, 4)), float(rnd.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, smiles string, e double").withColumn("y", F.length("smiles") + F.col("e") / 10)
    data = cv.prepare(df, "id", "smiles", "y", k=2, n_features=16)
    made, real = [], cv._estimator
    monkeypatch.setattr(cv, "_estimator", lambda kind, **p: made.append(tuple(p.values())) or real(kind, **p))
    out = cv.select_hyperparameters(data, {"reg_param": [0.001, 50.0, 0.001], "elastic_net": [0.0, 0.5], "max_iter": [20]}, n_runs=2).collect()
    assert len(made) == 2 * len(set(made)) == 8  # two runs each of four different ones
    assert [r.mean_score for r in out] == sorted(r.mean_score for r in out) and out[0].reg_param == 0.001
    drawn = cv.select_hyperparameters(data, {"reg_param": [0.001, 50.0], "standardize": [True, False], "max_iter": [1, 20]}, n_draws=3, n_runs=1)
    assert drawn.count() == 3


def test_classifiers_are_compared_by_log_loss(spark):
    df = spark.createDataFrame([(i, "CCO" if i % 2 else "NNN", int(i % 2)) for i in range(60)], "id long, smiles string, c int")
    data = cv.prepare(df, "id", "smiles", "c", k=2, n_features=16, kind="classification")
    found = {r.reg_param: r.mean_score for r in cv.select_hyperparameters(data, {"reg_param": [0.001, 100.0]}, n_runs=1).collect()}
    assert 0 <= found[0.001] < 0.1 < found[100.0] < 1
