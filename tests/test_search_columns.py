"""What the search sorts and stages for every prediction."""

from molspark.operators import tuning


def test_only_what_the_ranks_need_is_sorted(spark, monkeypatch):
    seen, real = [], tuning.ordinal
    monkeypatch.setattr(tuning, "ordinal", lambda df, *a, **k: seen.append(df.columns) or real(df, *a, **k))
    rows = [(c, float(w), s, float(s * w % 7)) for c in range(2) for w in range(3) for s in range(5)]
    preds = spark.createDataFrame(rows, "config_id long, weight double, sample_id long, pred double")
    assert tuning.least_correlated_by(preds, "config_id", keep=2).count() == 4
    assert seen[-1] == ["config_id", "_w", "pred", "_no"]
