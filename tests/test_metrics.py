"""Metrics against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from molspark.operators import metrics, scaling, similarity, tuning


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    n = 400
    y = rng.integers(0, 2, n)
    p = np.round(np.clip(0.4 * y + rng.random(n) * 0.6, 0, 1), 2)
    g = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 3, n))
    rows = [(int(i), int(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(g, y, p))]
    return spark.createDataFrame(rows, "id long, g int, target int, pred double"), rows


def curve(y, p):
    points = []
    for t in sorted(set(p), reverse=True):
        taken = p >= t
        points.append((t, y[taken].mean(), y[taken].sum() / y.sum()))
    return points


def test_pr_curve_and_area(scored):
    df, rows = scored
    got = metrics.pr_curve(df, ["g"])
    areas = {r["g"]: r["pr_auc"] for r in metrics.pr_auc(got, ["g"]).collect()}
    for g in range(3):
        y = np.array([r[2] for r in rows if r[1] == g])
        p = np.array([r[3] for r in rows if r[1] == g])
        want = curve(y, p)
        mine = sorted(((r["threshold"], r["precision"], r["recall"]) for r in got.where(f"g = {g}").collect()), reverse=True)
        np.testing.assert_allclose(mine, want)
        recall, precision = [0.0, *[w[2] for w in want]], [1.0, *[w[1] for w in want]]
        assert areas[g] == pytest.approx(np.trapezoid(precision, recall))


def test_curve_metrics_equal_direct_counts(scored):
    df, _ = scored
    a = {r["g"]: r for r in metrics.classification_metrics(df, ["g"]).collect()}
    for r in metrics.curve_metrics(metrics.pr_curve(df, ["g"]), ["g"]).collect():
        assert [r[m] for m in metrics.CLASSIFICATION[:4]] == [a[r["g"]][m] for m in metrics.CLASSIFICATION[:4]]


def test_no_noise_no_sigma(scored):
    df, _ = scored
    out = metrics.classification_sigma(df.withColumn("sigma", F.lit(0.0)), "id", ["g"], n_mc=4).collect()
    assert all(abs(v) < 1e-12 for r in out for v in list(r)[1:])


def test_noise_is_repeatable(scored):
    df, _ = scored
    noisy = df.withColumn("sigma", F.lit(0.2))
    run = lambda d: metrics.classification_sigma(d, "id", [], n_mc=20).first()
    a, b = run(noisy), run(noisy.repartition(7))
    assert all(x == pytest.approx(z, abs=1e-9) for x, z in zip(a, b)) and 0 < a["accuracy_sigma"] < 0.2


def test_zero_division_gives_zero(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "target int, pred double")
    r = metrics.classification_metrics(df, []).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_constant_target_scale_is_one(spark):
    df = spark.createDataFrame([(0, 5.0), (0, 5.0), (1, 1.0), (1, 3.0)], "fold int, v double")
    s = {r["fold"]: (r["center"], r["scale"]) for r in scaling.fit_robust(df, "v").collect()}
    assert s[0] == (5.0, 1.0) and s[1] == (2.0, pytest.approx(1.8))
    scaler = scaling.fit_robust(df, "v")
    back = scaling.inverse_transform(scaling.transform(df, scaler, "v", "s"), scaler, "s", "b").collect()
    assert all(r["v"] == pytest.approx(r["b"]) for r in back)


def test_histogram_has_unit_area(scored):
    df, rows = scored
    h = similarity.density_histogram(df.withColumn("series", F.lit("x")), "pred").orderBy("bin").collect()
    want, edges = np.histogram([r[3] for r in rows], bins=50, density=True)
    np.testing.assert_allclose(sum(r["density"] * (r["hi"] - r["lo"]) for r in h), 1)
    np.testing.assert_allclose([r["lo"] for r in h], edges[:-1])
    assert np.isclose([r["density"] for r in h], want).mean() > 0.8  # values sit on bin edges


def test_history_rules(spark):
    nan = float("nan")
    losses = {0: [5, 4, 4, nan, 6, 7, 8], 1: [3, 2, 1, 0.5]}
    rows = [(r, e, float(x)) for r, xs in losses.items() for e, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "run int, epoch int, val_loss double")
    best = {r["run"]: r["best_epoch"] for r in tuning.best_epoch(df).collect()}
    assert best == {0: 1, 1: 3}
    assert {r["run"]: r["stop_epoch"] for r in tuning.early_stop(df, 3).collect()} == {0: 4}
    late = tuning.after_burn_in(df, ignore_first=2)
    assert {r["run"]: r["best_epoch"] for r in tuning.best_epoch(late).collect()} == {0: 4, 1: 3}


@pytest.mark.parametrize("width", [1, 60])
def test_replicas_dealt_over_tasks_agree_with_ordered_ones(spark, width):
    """Groups with a null key, without positives, of one row, with many equal scores; ids of one and of several digest blocks."""
    data = [(f"{i:0{width}d}", ("a", "b", None, "zero", "one")[4 if i == 0 else i % 4], int(i % 3 == 0 and i % 4 != 3), (i % 5) / 5.0, 0.0 if i % 2 else 0.3) for i in range(120)]
    df = spark.createDataFrame(data, "id string, g string, target int, pred double, sigma double")
    for keys in (["g"], [], ["g", "target"]):
        found = [metrics.classification_sigma(df, "id", keys, n_mc=30, limit=limit) for limit in (10**6, 5)]
        left, right = (sorted((tuple(r) for r in f.select(*keys, *sorted(set(f.columns) - set(keys))).collect()), key=repr) for f in found)
        assert len(left) == len(right)
        for a, b in zip(left, right):
            assert a[: len(keys)] == b[: len(keys)] and a[len(keys) :] == pytest.approx(b[len(keys) :], abs=1e-9)


def test_replicas_of_no_rows(spark):
    df = spark.createDataFrame([], "id long, g string, target int, pred double, sigma double")
    assert metrics.classification_sigma(df, "id", ["g"], n_mc=3).collect() == []
