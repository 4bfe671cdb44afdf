"""Replicas of more rows than may travel: packed scores, several ranges, and no row per replica in a shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from molspark.operators import metrics


@pytest.mark.parametrize("cell_rows", [1 << 20, 40, 7])
def test_ranges_of_scores_add_up(spark, cell_rows):
    data = [(i, ("a", "b", None, "zero")[i % 4], int(i % 3 == 0 and i % 4 != 3), (i % 5) / 5.0 - 0.2, 0.0 if i % 2 else 0.3) for i in range(150)]
    df = spark.createDataFrame(data, "id long, g string, target int, pred double, sigma double")
    for keys in (["g"], []):
        want, got = (metrics.classification_sigma(df, "id", keys, n_mc=20, **more) for more in ({}, {"limit": 5, "cell_rows": cell_rows}))
        left, right = (sorted((tuple(r) for r in f.select(*keys, *sorted(set(f.columns) - set(keys))).collect()), key=repr) for f in (want, got))
        assert len(left) == len(right)
        for a, b in zip(left, right):
            assert a[: len(keys)] == b[: len(keys)] and a[len(keys) :] == pytest.approx(b[len(keys) :], abs=1e-9)


def test_packed_scores_come_back():
    rng = np.random.default_rng(1)
    score = np.sort(np.r_[rng.normal(size=200), 0.0, -0.0, 0.5, 0.5, -1e300, 1e300])
    hit = rng.random(len(score)) < 0.3
    key, got = metrics._unpacked(metrics._packed(metrics._sortable(score), hit), len(score))
    assert (key == metrics._sortable(score)).all() and (got == hit).all()
    assert (np.diff(key) >= 0).all() and ((np.diff(key) == 0) == (np.diff(score) == 0)).all()


def test_no_row_per_replica_is_made_for_a_shuffle(spark):
    df = spark.range(400).selectExpr("id", "int(id % 3 = 0) AS target", "(id % 97) / 97.0D AS pred", "0.1D AS sigma")
    out = metrics.classification_sigma(df, "id", [], n_mc=10, limit=5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and out.select(F.col("pr_auc_sigma") > 0).first()[0]
