"""Generation, cross-validation, discovery, report and streaming intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from molspark.catalog.base import heavy, MOLECULES_SQL, digest, grams, hexint, set_sql, molecules, query, r6, table, tok
from molspark.catalog.joins import molecule_scorer, pairs_sql
from molspark.catalog.selection import accepted_sql
from molspark.catalog.tokens import checks_sql
from molspark.functions import tokens as tk
from molspark.functions.hashing import leading_bits, seeded_digest
from molspark.operators import ensemble, generate, metrics, selection, splits
from molspark.plans import cross_validation as cv, discovery, stored
from molspark.staging import fresh_path
from molspark.streaming import intake, target

_PAIRS = f"""pairs AS (SELECT unnest(t[:-2]) AS cur, unnest(t[2:]) AS next FROM (SELECT {tok('smiles')} AS t FROM molecules)),
counts AS (SELECT cur, next, count(*) AS n FROM pairs GROUP BY ALL),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY cur) AS p FROM counts)"""


@query("ml7_transitions", f"WITH {MOLECULES_SQL}, {_PAIRS} SELECT cur, next, n, round(p, 9) AS p FROM shares")
def _(spark, sf):
    out = generate.transition_shares(generate.transition_counts(molecules(spark, sf)))
    return out.select("cur", "next", "n", F.round("p", 9).alias("p"))


_WALK = f"""weighted AS (SELECT cur, next, pow(p, 1 / 0.9::DOUBLE) AS w FROM shares),
cum AS (SELECT cur, next, w, sum(w) OVER (PARTITION BY cur ORDER BY next ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY cur) AS t,
 row_number() OVER (PARTITION BY cur ORDER BY next DESC) AS k FROM weighted),
iv AS (SELECT cur, next, (c - w) / t AS lo, CASE WHEN k = 1 THEN 1 ELSE c / t END AS hi FROM cum),
walk AS (SELECT p_partkey AS cand_id, 0 AS step, ' ' AS cur, '' AS smiles FROM part
 UNION ALL SELECT cand_id, step + 1, next, CASE WHEN next = ' ' THEN smiles ELSE smiles || next END FROM walk JOIN iv ON iv.cur = walk.cur
 AND ('0x' || substr(md5('42|' || cand_id || '|' || step), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= lo
 AND ('0x' || substr(md5('42|' || cand_id || '|' || step), 1, 8))::BIGINT / 4294967296.0::DOUBLE < hi
 WHERE step < 100 AND (step = 0 OR walk.cur <> ' ')),
drawn AS (SELECT cand_id, arg_max(smiles, step) AS smiles FROM walk GROUP BY 1)"""


@query("ml8_sampled_candidates", f"WITH RECURSIVE {MOLECULES_SQL}, {_PAIRS}, {_WALK} SELECT * FROM drawn")
def _(spark, sf):
    shares = generate.cumulative_shares(generate.transition_counts(molecules(spark, sf)))
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("cand_id"))
    return generate.sample(ids, shares, 42)


def text_model(spark, sf, kind="regression"):
    """Prepared documents: length from text, or quality class from text."""
    docs = heavy(spark, sf, "documents").select("doc_id", "text", (F.col("n_chars") / 1000.0).alias("kchars"))
    if kind == "classification":
        docs = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    target = "quality" if kind == "classification" else "kchars"
    return docs, cv.prepare(docs, "doc_id", "text", target, k=2, n_features=128, kind=kind)


@query("ml1_out_of_fold_predictions")
def _(spark, sf):
    docs, data = text_model(spark, sf)
    oof = cv.out_of_fold(cv.train_ensemble(data, n_runs=2), data)
    base = docs.select(F.col("doc_id").alias("row_id"), "kchars")
    return cv.predictions_table(base, oof).select(
        F.col("row_id").alias("doc_id"), "kchars", "fold", r6(F.col("mean"), "mean"), r6(F.col("sigma"), "sigma")
    )


@query("ml1_ml3_regression_scores")
def _(spark, sf):
    _, data = text_model(spark, sf)
    long = cv.evaluate(cv.out_of_fold(cv.train_ensemble(data, n_runs=2), data))
    return long.select("fold", "set", "metric", F.round("mean", 4).alias("mean"), F.round("sigma", 4).alias("sigma"))


@query("ml1_ml3_classification_scores")
def _(spark, sf):
    _, data = text_model(spark, sf, "classification")
    long = cv.evaluate(cv.out_of_fold(cv.train_ensemble(data, n_runs=2), data), "classification")
    return long.select("fold", "set", "metric", F.round("mean", 4).alias("mean"), F.round("sigma", 4).alias("sigma"))


@query("ml4_hyperparameters")
def _(spark, sf):
    _, data = text_model(spark, sf)
    out = cv.select_hyperparameters(data, {"reg_param": [0.001, 0.1, 10.0], "elastic_net": [0.0, 0.5], "max_iter": [5, 20]}, n_draws=6, n_runs=2)
    return out.select("reg_param", "elastic_net", "max_iter", F.round("mean_score", 6).alias("mean_score"))


@query("ml1_strings_variants_extras")
def _(spark, sf):
    """Two strings a row, several variants of them, and numbers besides; scores of every member."""
    rows = table(spark, sf, "part").select(
        "p_partkey", "p_name", "p_type", F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 100 / 10.0).alias("x"),
        (F.col("p_size") / 10.0 + F.length("p_name") / 20.0).alias("y"),
    )
    variants = half_turned(tk.join_strings(F.array("p_name", "p_type")))
    data = cv.prepare(rows, "p_partkey", ["p_name", "p_type"], "y", k=3, n_features=128, variants=variants, extras=["size", "x"])
    model = cv.train_ensemble(data, n_runs=3, run_subset=[0, 2])
    scores = cv.run_scores(model, data)
    return scores.select("fold", "run", "set", *(F.round(c, 4).alias(c) for c in ("rmse", "mae", "r2")))


# Members with coefficients that SQL can make too: whole thousandths from a digest.
_STORED_FEATURES = 64
_STORED_SQL = f"""g AS (SELECT mol_id, unnest(list_concat({tok('smiles')}, {grams(tok('smiles'), 2)})) AS g FROM molecules),
entries AS (SELECT mol_id, {hexint('md5(g)')} % {_STORED_FEATURES} AS j, count(*) AS c FROM g GROUP BY ALL),
coefs AS (SELECT f, r, j, ({hexint(digest('w', "(f || '|' || r || '|' || j)"))} % 2001 - 1000) / 1000.0::DOUBLE AS w
 FROM (SELECT unnest(range(5)) AS f), (SELECT unnest(range(5)) AS r), (SELECT unnest(range({_STORED_FEATURES})) AS j)),
scored AS (SELECT mol_id, f::INT AS fold, r::INT AS run, (f + r / 10.0::DOUBLE + sum(c * w)) * (1 + f / 4.0::DOUBLE) + 0.5::DOUBLE * f AS pred FROM entries JOIN coefs USING (j) GROUP BY mol_id, f, r)"""


def stored_members(spark, sf):
    """Five folds by five runs, saved and so read back from a folder."""
    cell = spark.range(25).select(F.expr("CAST(id DIV 5 AS INT)").alias("fold"), F.expr("CAST(id % 5 AS INT)").alias("run"))
    weight = lambda j: (leading_bits(seeded_digest("w", F.col("fold"), F.col("run"), j), 8) % 2001 - 1000) / 1000.0
    members = cell.select(
        "fold", "run", F.lit("regression").alias("kind"), F.lit(_STORED_FEATURES).alias("n_features"), (F.col("fold") + F.col("run") / 10.0).alias("intercept"),
        F.transform(F.sequence(F.lit(0), F.lit(_STORED_FEATURES - 1)), weight).alias("coefficients"),
        (F.col("fold") * 0.5).alias("center"), (1 + F.col("fold") / 4.0).alias("scale"),
        F.array().cast("array<double>").alias("extra_center"), F.array().cast("array<double>").alias("extra_scale"),
    )
    folder = fresh_path(spark, "ensemble")
    stored.save(members, folder)
    return folder


@query("src7_ml2_stored_inference", f"""WITH {MOLECULES_SQL}, {_STORED_SQL}
SELECT mol_id, round(avg(pred), 6) AS mean, round(stddev_pop(pred), 6) AS sigma FROM scored WHERE fold IN (1, 3) AND run IN (0, 2, 4) GROUP BY mol_id""")
def _(spark, sf):
    model = stored.load(spark, stored_members(spark, sf), folds=[1, 3], runs=[0, 2, 4])
    out = model.infer(molecules(spark, sf).select("mol_id", "smiles"), "smiles", "mol_id")
    return out.select("mol_id", r6(F.col("mean"), "mean"), r6(F.col("sigma"), "sigma"))


_OWN_SQL = f"""own AS (SELECT mol_id, property, (ntile(5) OVER (ORDER BY {digest(123, 'mol_id')}, mol_id) - 1)::INT AS fold FROM molecules),
oof AS (SELECT mol_id, property, fold, run, pred FROM own JOIN scored USING (mol_id, fold))"""


def stored_out_of_fold(spark, sf):
    rows = splits.shuffled_kfold(molecules(spark, sf).select("mol_id", "smiles", "property"), "mol_id", 5)
    model = stored.load(spark, stored_members(spark, sf))
    return rows, model.out_of_fold(rows, "smiles", "mol_id")


@query("ml1_stored_out_of_fold", f"""WITH {MOLECULES_SQL}, {_STORED_SQL}, {_OWN_SQL}
SELECT mol_id, fold, round(avg(pred), 6) AS mean, round(stddev_pop(pred), 6) AS sigma FROM oof GROUP BY mol_id, fold""")
def _(spark, sf):
    """Held-out predictions of five folds by five runs."""
    _, preds = stored_out_of_fold(spark, sf)
    out = ensemble.mean_sigma(preds, ["mol_id", "fold"])
    return out.select("mol_id", "fold", r6(F.col("mean"), "mean"), r6(F.col("sigma"), "sigma"))


@query("ml1_ml3_stored_scores", f"""WITH {MOLECULES_SQL}, {_STORED_SQL}, {_OWN_SQL}
SELECT fold, run, round(sqrt(avg((property - pred) ** 2)), 5) AS rmse, round(avg(abs(property - pred)), 5) AS mae,
 round(1 - sum((property - pred) ** 2) / (var_pop(property) * count(*)), 5) AS r2 FROM oof GROUP BY fold, run""")
def _(spark, sf):
    """Scores of each single member on the rows it has not seen."""
    rows, preds = stored_out_of_fold(spark, sf)
    out = metrics.regression_metrics(preds.join(rows.select("mol_id", "property"), "mol_id"), ["fold", "run"], "property", "pred")
    return out.select("fold", "run", *(F.round(c, 5).alias(c) for c in ("rmse", "mae", "r2")))


@query("ml1_classification_run_scores")
def _(spark, sf):
    """Scores of every single member of a classifier."""
    _, data = text_model(spark, sf, "classification")
    scores = cv.run_scores(cv.train_ensemble(data, n_runs=2), data)
    return scores.select("fold", "run", "set", *(F.round(c, 4).alias(c) for c in metrics.CLASSIFICATION))


_DRAWN = _WALK.replace("p_partkey AS cand_id", "range AS cand_id").replace("FROM part\n", "FROM (SELECT unnest(range((SELECT 5 * greatest(100, count(*) // 20) FROM molecules))) AS range)\n")


@query("ml10_one_cycle", f"""WITH RECURSIVE {MOLECULES_SQL}, {_PAIRS}, {_DRAWN},
c AS (SELECT cand_id, smiles, {checks_sql('smiles')}, NOT regexp_matches(smiles, '[.+-]') AS neutral FROM drawn),
k AS (SELECT smiles, min(cand_id) AS cand_id FROM c WHERE covered AND parens AND brackets AND rings AND neutral GROUP BY 1 ORDER BY 2 LIMIT (SELECT greatest(100, count(*) // 20) FROM molecules)),
p AS (SELECT smiles, cand_id, length(smiles) * 0.375::DOUBLE + cand_id % 7 AS property FROM k)
SELECT smiles, round(property, 6) AS property, 0::INT AS iter FROM p ORDER BY property DESC, cand_id LIMIT (SELECT ceil(count(*) * 0.5)::BIGINT FROM p)""")
def _(spark, sf):
    """Generate, filter, score and select once, with a linear score in place of a fitted model."""
    mols = molecules(spark, sf)
    predict = lambda c: c.withColumn("mean", F.length("smiles") * 0.375 + F.col("cand_id") % 7)
    score = lambda c: c.select("cand_id", F.lit(1.0).alias("sa_score"))
    options = discovery.LoopOptions(n_generate=max(100, mols.count() // 20), attempts=5, max_generation=-1)
    return discovery.discover(mols.where("mol_id % 2 = 0"), mols.where("mol_id % 2 = 1"), predict, score, options)


def half_turned(text):
    """The string and its rotation by half its tokens: two variants of the same ring of tokens."""
    tokens = tk.body_tokens(text)
    turned = F.array_join(tk.rotate(tokens, F.floor(F.size(tokens) / 2).cast("int")), "")
    return F.array_distinct(F.array(text, turned))


def molecule_loop(spark, sf, options):
    """Discovery over half of the molecules as labeled, half as unlabeled, with variants in training and inference."""
    mols = molecules(spark, sf)
    labeled, unlabeled = mols.where("mol_id % 2 = 0"), mols.where("mol_id % 2 = 1")
    data = cv.prepare(labeled, "mol_id", "smiles", "property", k=2, n_features=64, variants=half_turned(F.col("smiles")))
    model = cv.train_ensemble(data, n_runs=2)
    return discovery.discover(
        labeled, unlabeled, lambda c: model.infer(c, "smiles", "cand_id", half_turned(F.col("smiles"))), molecule_scorer(spark, sf), options
    )


@query("ml10_discovery")
def _(spark, sf):
    n = max(100, molecules(spark, sf).count() // 20)
    options = discovery.LoopOptions(n_generate=n, cycles=2, max_generation=-1, score_limit=9.0)
    return molecule_loop(spark, sf, options).select("smiles", r6(F.col("property"), "property"), "iter")


def _hist_sql(name: str) -> str:
    return f"""h_{name} AS (SELECT CASE WHEN sim IS NULL THEN -1 ELSE least(floor((sim - 0.5) / 0.01 + 1e-9), 49) END::INT AS bin, sum(n_pairs) AS n FROM {name}_dist GROUP BY 1),
o_{name} AS (SELECT '{name}' AS series, b::INT AS bin, CASE WHEN b < 0 THEN 0 ELSE round(0.5 + b * 0.01::DOUBLE, 6) END AS lo,
 round(0.5 + (b + 1) * 0.01::DOUBLE, 6) AS hi, coalesce(n, 0)::BIGINT AS n_pairs FROM (SELECT unnest(range(-1, 50)) AS b) LEFT JOIN h_{name} ON bin = b)"""


@query("ml11_similarity_report", f"""WITH ft AS (SELECT item_id AS id, {set_sql(tok('text'))} AS bits FROM benchmark),
fg AS (SELECT doc_id AS id, {set_sql(tok('text'))} AS bits FROM documents), {pairs_sql('ft', 0.5, 'training_')}, {pairs_sql('fg', 0.5, 'generated_')},
{_hist_sql('training')}, {_hist_sql('generated')} SELECT * FROM o_training UNION ALL SELECT * FROM o_generated""")
def _(spark, sf):
    out = discovery.similarity_report({
        "training": table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("smiles")),
        "generated": heavy(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("smiles")),
    }, "id")
    return out.select("series", "bin", r6(F.col("lo"), "lo"), r6(F.col("hi"), "hi"), "n_pairs")


@query("ml11_ranked_candidates", f"""WITH {MOLECULES_SQL}, c AS (SELECT smiles, property, 0 AS iter FROM molecules)
(SELECT *, 'top' AS "end" FROM c ORDER BY property DESC, smiles LIMIT 7) UNION ALL (SELECT *, 'bottom' FROM c ORDER BY property, smiles DESC LIMIT 4)""")
def _(spark, sf):
    rows = molecules(spark, sf).select("smiles", "property", F.lit(0).alias("iter"))
    return discovery.ranked_candidates(rows, fresh_path(spark, "ranked"), 7, 4)


@query("str1_streaming_intake", f"WITH {accepted_sql()} SELECT DISTINCT smiles FROM kept")
def _(spark, sf):
    folder = fresh_path(spark, "arrivals")
    rows = molecules(spark, sf).select("mol_id", "smiles")
    rows.repartition(4).write.parquet(folder)
    return intake.intake(spark, folder, rows.schema)


_PARTS = 4


@query("str1_until_target", f"""WITH {accepted_sql()}, part AS (SELECT mol_id, smiles, mol_id * {_PARTS} // (SELECT max(mol_id) + 1 FROM molecules) AS part, (SELECT count(DISTINCT smiles) // 2 FROM kept) AS target FROM molecules),
news AS (SELECT part, count(*) AS n FROM (SELECT min(part) AS part FROM part WHERE mol_id IN (SELECT mol_id FROM kept) GROUP BY smiles) GROUP BY part),
sums AS (SELECT part, sum(n) OVER (ORDER BY part) AS done FROM news),
last AS (SELECT min(part) AS part FROM sums WHERE done >= (SELECT any_value(target) FROM part)),
taken AS (SELECT * FROM part WHERE part <= (SELECT part FROM last)),
k AS (SELECT count(*) AS kept, count(DISTINCT smiles) AS uniq FROM taken WHERE mol_id IN (SELECT mol_id FROM kept)),
v AS (SELECT count(*) AS valid FROM taken WHERE mol_id IN (SELECT mol_id FROM checked WHERE covered AND parens AND brackets AND rings))
SELECT (SELECT count(*) FROM taken) AS attempts, valid, kept, kept - uniq AS duplicates, least(uniq, target)::BIGINT AS accepted, (target - least(uniq, target))::BIGINT AS shortfall
FROM k, v, (SELECT any_value(target) AS target FROM part)""")
def _(spark, sf):
    """Arrivals in parts, an intake that is restarted after each and stops when half of all strings are accepted."""
    rows = molecules(spark, sf).select("mol_id", "smiles")
    goal = selection.acceptance(rows, 0).select(F.expr("(kept - duplicates) DIV 2")).first()[0]
    last = rows.agg(F.max("mol_id") + 1).first()[0]
    folder, out = fresh_path(spark, "arrivals"), fresh_path(spark, "target")
    for k in range(_PARTS):
        rows.where(F.expr(f"mol_id * {_PARTS} DIV {last}") == k).write.mode("append").parquet(folder)
        if target.run_until(intake.candidate_stream(spark, folder, rows.schema), out, goal):
            break
    return target.acceptance(spark, out, goal)
