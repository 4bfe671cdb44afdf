"""Generation, ensembles, the discovery loop and streaming."""

import pytest
from pyspark.sql import functions as F, types as T

from molspark.operators import generate
from molspark.plans import cross_validation as cv, discovery
from molspark.streaming import intake


@pytest.fixture(scope="module")
def pool(spark):
    parts = ["CCO", "CCN", "c1ccccc1", "CC(=O)O", "CCCl", "NCCO", "OCC", "CCBr"]
    rows = [(i, parts[i % 8] + parts[(i * 5) % 7] * (i % 3), float(i % 8)) for i in range(240)]
    return spark.createDataFrame(rows, "mol_id long, smiles string, property double")


def test_sampling_ways_agree(spark, pool):
    shares = generate.cumulative_shares(generate.transition_counts(pool))
    ids = spark.range(120).withColumnRenamed("id", "cand_id")
    a = sorted(generate.sample(ids, shares, 5, max_length=12).collect())
    b = sorted(generate.sample(ids.repartition(3), shares, 5, max_length=12, limit=1).collect())
    assert a == b and len({r["smiles"] for r in a}) > 20


def test_shares_cover_the_unit_interval(pool):
    rows = generate.cumulative_shares(generate.transition_counts(pool), 0.5).orderBy("cur", "next").collect()
    by = {}
    for r in rows:
        by.setdefault(r["cur"], []).append((r["lo"], r["hi"]))
    for spans in by.values():
        assert spans[0][0] == 0 and spans[-1][1] == 1
        assert all(x[1] == pytest.approx(y[0]) for x, y in zip(spans, spans[1:]))


def test_ensemble_learns_and_is_repeatable(pool):
    target = pool.withColumn("property", F.length("smiles").cast("double"))
    data = cv.prepare(target, "mol_id", "smiles", "property", k=3, n_features=64)
    oof = cv.out_of_fold(cv.train_ensemble(data, n_runs=2, reg_param=1e-3), data)
    assert oof.groupBy("row_id").count().where("count <> 3").isEmpty()
    long = {(r["fold"], r["set"], r["metric"]): r["mean"] for r in cv.evaluate(oof).collect()}
    assert long[-1, "final", "r2"] > 0.9
    wide = cv.fold_scores(cv.evaluate(oof))
    assert wide.count() == 3 and len(wide.columns) == 19
    again = cv.out_of_fold(cv.train_ensemble(data, n_runs=2, reg_param=1e-3), data)
    a, b = (sorted((r["row_id"], r["fold"], round(r["mean"], 6)) for r in d.collect()) for d in (oof, again))
    assert a == b
    same = data.rows.groupBy("text").agg(F.count_distinct("fold").alias("n"))
    assert same.where("n > 1").isEmpty()


def test_infer_keeps_rejected_rows_as_null(spark, pool):
    data = cv.prepare(pool, "mol_id", "smiles", "property", k=2, n_features=32)
    model = cv.train_ensemble(data, n_runs=1)
    df = spark.createDataFrame([(1, "CCO"), (2, None)], "src_id long, smiles string")
    out = {r["src_id"]: r["mean"] for r in model.infer(df, "smiles", "src_id").collect()}
    assert out[1] is not None and out[2] is None and len(out) == 2


def test_hyperparameters_prefer_weak_penalty(pool):
    target = pool.withColumn("property", F.length("smiles").cast("double"))
    data = cv.prepare(target, "mol_id", "smiles", "property", k=2, n_features=64)
    best = cv.select_hyperparameters(data, {"reg_param": [0.001, 50.0]}, n_runs=1).first()
    assert best["reg_param"] == 0.001


def loop(pool, options, sa=2.0):
    predict = lambda c: c.withColumn("mean", F.length("smiles").cast("double"))
    score = lambda c: c.select("cand_id", F.lit(sa).alias("sa_score"))
    return discovery.discover(pool, pool.select("smiles"), predict, score, options)


def test_loop_stops_by_cycles(pool):
    out = loop(pool, discovery.LoopOptions(n_generate=40, attempts=3, cycles=2, max_generation=-1)).collect()
    assert {r["iter"] for r in out} == {0, 1}
    for i in (0, 1):
        rows = [r for r in out if r["iter"] == i]
        assert len(rows) == len({r["smiles"] for r in rows}) <= 20
        assert not any(ch in r["smiles"] for r in rows for ch in ".+-")


def test_loop_stops_by_count_and_by_score(pool):
    few = loop(pool, discovery.LoopOptions(n_generate=40, attempts=3, cycles=9, max_generation=25)).collect()
    assert max(r["iter"] for r in few) == 1
    assert loop(pool, discovery.LoopOptions(n_generate=40, cycles=9), sa=7.5).count() == 0


def test_classification_loop_and_novelty(pool, tmp_path):
    options = discovery.LoopOptions(n_generate=30, attempts=3, kind="classification", novel_only=True, dump_folder=str(tmp_path))
    out = loop(pool, options).collect()
    known = {r["smiles"] for r in pool.collect()}
    assert out and all(r["property"] > 0.5 and r["smiles"] not in known for r in out)
    assert (tmp_path / "selected" / "iter=0").exists() and (tmp_path / "labeled" / "iter=0").exists()


def test_stream_restarts_without_repeats(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = T.StructType([T.StructField("smiles", T.StringType())])
    put = lambda xs: spark.createDataFrame([(x,) for x in xs], schema).write.mode("append").parquet(folder)
    run = lambda: intake.drain(intake.accepted(intake.candidate_stream(spark, folder, schema)), out, state)
    put(["CCO", "CCO", "C(", "CC.O"])
    run()
    put(["CCO", "CCN"])
    run()
    assert sorted(r[0] for r in spark.read.schema(schema).parquet(out).collect()) == ["CCN", "CCO"]


def test_extras_strings_and_subsets(spark, pool):
    """A target that only the extra column explains; two strings a row; a subset of folds and runs."""
    rows = pool.select("mol_id", "smiles", F.lit("CC").alias("other"), (F.col("mol_id") % 17).cast("double").alias("x"), (F.col("mol_id") % 17 * 3.0).alias("y"))
    with_x = cv.prepare(rows, "mol_id", ["smiles", "other"], "y", k=3, n_features=32, extras=["x"])
    without = cv.prepare(rows, "mol_id", ["smiles", "other"], "y", k=3, n_features=32)
    fit = lambda d: {(r["fold"], r["set"], r["metric"]): r["mean"] for r in cv.evaluate(cv.out_of_fold(cv.train_ensemble(d, 2, 1e-3), d)).collect()}
    assert fit(with_x)[-1, "final", "r2"] > 0.99 > 0.5 > fit(without)[-1, "final", "r2"]
    model = cv.train_ensemble(with_x, 3, fold_subset=[1], run_subset=[0, 2])
    assert set(model.members) == {(1, 0), (1, 2)}
    scores = cv.run_scores(model, with_x)
    assert {(r["fold"], r["run"], r["set"]) for r in scores.collect()} == {(1, r, s) for r in (0, 2) for s in ("train", "valid", "test")}
    assert with_x.table.count() == pool.count()  # features are stored once
    cands = rows.select("mol_id", "smiles", "other", "x")
    assert model.infer(cands, ["smiles", "other"], "mol_id", extras=["x"]).where("mean IS NULL").isEmpty()
    with pytest.raises(ValueError):
        model.infer(cands, ["smiles", "other"], "mol_id")


def test_held_out_predictions_carry_their_fold(spark, pool):
    data = cv.prepare(pool, "mol_id", "smiles", "property", k=3, n_features=32)
    table = cv.predictions_table(pool.select(F.col("mol_id").alias("row_id")), cv.out_of_fold(cv.train_ensemble(data, 1), data))
    own = {r["row_id"]: r["fold"] for r in data.rows.collect()}
    assert {r["row_id"]: r["fold"] for r in table.collect()} == own


def test_pca_and_clusters_against_numpy(spark):
    import numpy as np
    from molspark.operators import interpret
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0, 0, 9.0], [9, 0, 0, 0], [0, 9, 9, 0]])
    x = np.concatenate([c + rng.normal(0, 0.3, (40, 4)) for c in centres])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    found = np.array([(r["pc1"], r["pc2"]) for r in interpret.project_vectors(df, "id", "v").orderBy("id").collect()])
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(found), np.abs(x @ axes[:2].T), atol=1e-6)
    rows = interpret.cluster_vectors(df, "id", "v", 3).orderBy("id").collect()
    labels = np.array([r["cluster"] for r in rows])
    assert all(len(set(labels[i : i + 40])) == 1 for i in (0, 40, 80)) and len(set(labels)) == 3
    means = np.array([x[labels == l].mean(axis=0) for l in range(3)])
    assert np.allclose([r["distance"] for r in rows], np.linalg.norm(x - means[labels], axis=1), atol=1e-6)


def test_classifier_learns(spark, pool):
    rows = pool.withColumn("y", F.col("smiles").contains("Cl").cast("int"))
    data = cv.prepare(rows, "mol_id", "smiles", "y", k=2, n_features=64, kind="classification")
    oof = cv.out_of_fold(cv.train_ensemble(data, 1), data).where("split = 'test'")
    assert oof.where("(mean > 0.5) = (target = 1)").count() > 0.95 * oof.count()


def test_hyperparameters_score_table(spark, pool):
    """Scores are the mean squared errors of the same ensembles, computed by hand."""
    data = cv.prepare(pool, "mol_id", "smiles", "property", k=2, n_features=32)
    table = {r["reg_param"]: r["mean_score"] for r in cv.select_hyperparameters(data, {"reg_param": [0.01, 1.0]}, n_runs=2, seed=21).collect()}
    center, scale = data.scales[0]
    for reg, score in table.items():
        model = cv.train_ensemble(data, 2, reg, 21, fold_subset=[0])
        preds = cv.member_predictions(model, data).where("split = 'valid'")
        errors = preds.groupBy("run").agg(F.avg(F.pow((F.col("pred") - F.col("target")) / scale, 2)).alias("e")).collect()
        assert score == pytest.approx(sum(r["e"] for r in errors) / 2, rel=1e-6)
