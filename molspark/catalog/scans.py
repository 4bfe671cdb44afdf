"""Sources, sinks and input shaping. Files are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from molspark.catalog.base import query, r6, table, tok
from molspark.functions import scores, tokens as tk
from molspark.operators import accessibility, scaling, shaping, splits, vocabulary
from molspark.sources import readers, writers
from molspark.staging import fresh_path


@query("src1_csv_labeled", "SELECT c_name || ' ' AS smiles, c_acctbal AS property FROM customer")
def _(spark, sf):
    path = fresh_path(spark, "labeled")
    rows = table(spark, sf, "customer").select(
        F.concat("c_name", F.lit(" ")).alias("smiles"), F.col("c_acctbal").alias("property")
    )
    writers.write_csv(rows, path)
    return readers.read_labeled(spark, path)


_ODD = """CASE c_custkey % 5 WHEN 0 THEN 'a"b' WHEN 1 THEN concat('l1', chr(10), 'l2') WHEN 2 THEN 'x,y' WHEN 3 THEN concat('C', chr(92), 'N') ELSE ' ' END"""


@query("src1_csv_columns_by_name", f"SELECT concat(c_name, {_ODD}) AS smiles, c_acctbal AS property FROM customer")
def _(spark, sf):
    """Swapped and further columns; quotes, backslashes, commas and line breaks in values."""
    path = fresh_path(spark, "labeled")
    rows = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS property", f"concat(c_name, {_ODD}) AS smiles", "c_mktsegment AS note")
    writers.write_csv(rows, path)
    return readers.read_labeled(spark, path)


@query("src8_iteration_dump_breaks", f"SELECT concat({_ODD}, c_name) AS smiles, c_acctbal AS property, 2 AS iter FROM customer")
def _(spark, sf):
    folder = fresh_path(spark, "dumps")
    rows = table(spark, sf, "customer").selectExpr(f"concat({_ODD}, c_name) AS smiles", "c_acctbal AS property")
    writers.dump_iteration(rows, rows, folder, 2)
    return readers.read_table(spark, f"{folder}/labeled", T.StructType.fromDDL("smiles string, property double, iter int"))


@query("src1_csv_unlabeled", "SELECT s_name AS smiles FROM supplier")
def _(spark, sf):
    path = fresh_path(spark, "unlabeled")
    writers.write_csv(table(spark, sf, "supplier").select(F.col("s_name").alias("smiles")), path)
    return readers.read_unlabeled(spark, path)


@query("src2_smi_lines", """SELECT replace(p_name, ' ', '_') AS smiles,
CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand || ' ' || p_type END AS name FROM part""")
def _(spark, sf):
    path = fresh_path(spark, "lines")
    name = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit(" "), "p_brand", F.lit(" "), "p_type")).otherwise("")
    table(spark, sf, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), name).alias("value")).write.text(path)
    return readers.read_smi(spark, path)


@query("src3_sdf_records", """SELECT c_name AS name, c_mktsegment || chr(10) || 'and ' || c_name AS "segment+", CASE WHEN c_custkey % 3 = 0 THEN NULL
ELSE c_nationkey::VARCHAR END AS nation FROM customer""")
def _(spark, sf):
    path = fresh_path(spark, "records")
    nation = F.when(
        F.col("c_custkey") % 3 != 0, F.concat(F.lit("> <nation>\n"), F.col("c_nationkey").cast("string"), F.lit("\n\n"))
    ).otherwise("")
    record = F.concat(
        "c_name", F.lit("\n  made\n\n  0  0\nM  END\n> <segment+>\n"), "c_mktsegment", F.lit("\nand "), "c_name", F.lit("\n\n"), nation
    )
    table(spark, sf, "customer").select(record.alias("value")).write.text(path, lineSep="$$$$\n")
    return readers.read_sdf(spark, path, ["segment+", "nation"])


@query("src4_fragment_scores", """WITH r AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS o FROM lineitem),
p AS (SELECT o, l_extendedprice AS score, l_partkey AS fragment_id FROM r UNION ALL SELECT o, l_extendedprice, l_suppkey FROM r)
SELECT fragment_id, arg_max(score, o) AS score FROM p GROUP BY ALL""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("o"),
        F.array("l_extendedprice", F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double")).alias("v"),
    )
    return accessibility.invert_contributions(rows, "v", "o")


@query("src5_vocabulary_reuse", f"""SELECT token, (row_number() OVER (ORDER BY token) + 1)::INT AS token_id FROM
(SELECT DISTINCT unnest({tok('text')}) AS token FROM conversations) UNION ALL SELECT 'pad', 0 UNION ALL SELECT 'unk', 1""")
def _(spark, sf):
    path = fresh_path(spark, "vocabulary")
    build = lambda t, c: vocabulary.build_vocabulary(table(spark, sf, t).select(tk.tokenize(F.col(c)).alias("tokens")))
    writers.saved_vocabulary(spark, path, lambda: build("conversations", "text"))
    return writers.saved_vocabulary(spark, path, lambda: build("part", "p_name"))


def fold_scaler(spark, sf):
    """Scaler of lineitem prices on the training rows of five folds."""
    rows = table(spark, sf, "lineitem").where("l_linenumber < 6").select(
        (F.col("l_orderkey") % 5).cast("int").alias("fold"), "l_extendedprice"
    )
    return scaling.fit_robust(rows, "l_extendedprice")


SCALER_SQL = """scaler AS (SELECT (l_orderkey % 5)::INT AS fold, quantile_cont(l_extendedprice, 0.5) AS center,
 CASE WHEN quantile_cont(l_extendedprice, 0.95) = quantile_cont(l_extendedprice, 0.05) THEN 1
 ELSE quantile_cont(l_extendedprice, 0.95) - quantile_cont(l_extendedprice, 0.05) END AS scale
 FROM lineitem WHERE l_linenumber < 6 GROUP BY 1)"""


@query("src6_scaler_reuse", f"WITH {SCALER_SQL} SELECT fold, round(center, 6) AS center, round(scale, 6) AS scale FROM scaler")
def _(spark, sf):
    path = fresh_path(spark, "scaler")
    writers.saved_scaler(spark, path, lambda: fold_scaler(spark, sf))
    again = writers.saved_scaler(spark, path, lambda: fold_scaler(spark, sf).limit(0))
    return again.select("fold", r6(F.col("center"), "center"), r6(F.col("scale"), "scale"))


@query("src7_manifest", """SELECT count(DISTINCT CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 4 END) AS n_folds,
count(DISTINCT CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 3 END) AS n_runs, true AS scale_output, false AS has_extra FROM orders""")
def _(spark, sf):
    model = F.concat(
        F.lit("/a/Models/d_Model_Fold_"), (F.col("o_orderkey") % 4).cast("string"),
        F.lit("_Run_"), (F.col("o_custkey") % 3).cast("string"), F.lit(".hdf5"),
    )
    scaler = F.concat(F.lit("/a/Other/Scalers/d_Scaler_Outputs_Fold_"), (F.col("o_orderkey") % 4).cast("string"))
    paths = table(spark, sf, "orders").select(F.explode(F.array(model, scaler)).alias("path"))
    return readers.manifest(paths)


@query("src8_iteration_dumps", """SELECT 'selected' AS kind, p_name AS smiles, p_retailprice AS property, 3 AS iter FROM part WHERE p_size > 25
UNION ALL SELECT 'labeled', p_name, p_retailprice, 3 FROM part
UNION ALL SELECT 'ranked', p_name, p_retailprice, 3 FROM part WHERE p_size > 25""")
def _(spark, sf):
    folder = fresh_path(spark, "dumps")
    rows = table(spark, sf, "part")
    pick = lambda df: df.select(F.col("p_name").alias("smiles"), F.col("p_retailprice").alias("property"))
    writers.dump_iteration(pick(rows.where("p_size > 25")), pick(rows), folder, 3)
    writers.write_ranked(pick(rows.where("p_size > 25")), f"{folder}/ranked/iter=3")
    schema = T.StructType.fromDDL("smiles string, property double, iter int")
    back = lambda kind: readers.read_table(spark, f"{folder}/{kind}", schema).select(F.lit(kind).alias("kind"), "smiles", "property", "iter")
    return back("selected").unionByName(back("labeled")).unionByName(back("ranked"))


@query("src9_prediction_csv", """SELECT l_orderkey, l_linenumber, l_extendedprice AS mean, l_tax AS sigma FROM lineitem""")
def _(spark, sf):
    path = fresh_path(spark, "predictions")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("mean"), F.col("l_tax").alias("sigma")
    )
    writers.write_csv(rows, path)
    return readers.read_table(spark, path, rows.schema)


@query("src10_score_report", """SELECT p_name AS smiles, p_brand AS "Name", CASE WHEN p_size % 7 = 0 THEN 'None' ELSE
printf('%.6f', p_size / 8.0::DOUBLE) END AS sa_score FROM part WHERE p_partkey % 5 <> 0""")
def _(spark, sf):
    path = fresh_path(spark, "report")
    rows = table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("smiles"), F.col("p_brand").alias("name"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 8.0).alias("sa_score"),
    )
    writers.write_score_report(rows, path)
    return spark.read.csv(path, sep="\t", header=True, schema="smiles string, Name string, sa_score string")


@query("prj1_projection", "SELECT p_name, p_retailprice FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_name", "p_retailprice")


@query("prj3_prj4_assemble", """SELECT CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_name END AS "SMILES_1", p_brand AS "SMILES_2", p_retailprice AS "price",
p_retailprice - p_size AS "Minimum", p_retailprice + p_size AS "Maximum", p_size, p_partkey FROM part""")
def _(spark, sf):
    rows = table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 6 != 0, F.col("p_name")).alias("p_name"), "p_brand", "p_retailprice", "p_size", "p_partkey",
        (F.col("p_retailprice") - F.col("p_size")).alias("lo"), (F.col("p_retailprice") + F.col("p_size")).alias("hi"),
    )
    return shaping.assemble(rows, ["p_name", "p_brand"], "p_retailprice", ["lo", "hi"], ["p_size", "p_partkey"], "price")


@query("prj3_single_header", """SELECT p_name AS "SMILES", p_retailprice AS property, p_size AS "Standard deviation" FROM part""")
def _(spark, sf):
    return shaping.assemble(table(spark, sf, "part"), ["p_name"], "p_retailprice", ["p_size"], label_name="property")


@query("prj9_error_bars", """SELECT o_orderkey, round(abs(v - 0.5 - v), 6) AS err_low, round(abs(v + o_custkey % 7 - v), 6) AS err_high,
(o_custkey % 5)::DOUBLE AS err_std FROM (SELECT *, o_totalprice / 1000 AS v FROM orders)""")
def _(spark, sf):
    v = F.col("o_totalprice") / 1000
    std = (F.col("o_custkey") % 5).cast("double")
    three = [std, v - 0.5, v + F.col("o_custkey") % 7]
    bars = scores.error_bars(v, three, "minmax")
    return table(spark, sf, "orders").select(
        "o_orderkey", *[r6(c, n) for n, c in bars.items()], scores.error_bars(v, three, "std")["err_std"].alias("err_std")
    )


@query("prj10_minibatches", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
n AS (SELECT count(*) AS n FROM orders)
SELECT o_orderkey, (i // 64)::BIGINT AS batch, ceil(n / 64.0)::BIGINT AS n_batches FROM r, n""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    n = orders.count()
    rows = splits.minibatches(orders, [F.col("o_orderkey")], 64)
    return rows.select("o_orderkey", "batch", splits.batch_count(F.lit(n), 64).alias("n_batches"))
