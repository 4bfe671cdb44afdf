"""Filters, unions, sorts and acceptance accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from molspark.catalog.base import heavy, MOLECULES_SQL, molecules, query, table, tok
from molspark.catalog.tokens import checks_sql
from molspark.functions import tokens as tk
from molspark.operators import metrics, selection, splits, tuning, vocabulary
from molspark.operators.rank import ordinal
from molspark.plans import discovery


@query("flt3_positive", """SELECT doc_id, prob FROM (SELECT doc_id, (n_chars % 100) / 100.0::DOUBLE AS prob FROM documents) WHERE prob > 0.5""")
def _(spark, sf):
    return selection.keep_positive(
        heavy(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 100 / 100.0).alias("prob")), "prob"
    )


@query("flt4_drop_unpredicted", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 7 > 1")
def _(spark, sf):
    case = F.col("l_partkey") % 7
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(case == 0, F.lit(None)).when(case == 1, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("mean"),
        F.col("l_tax").alias("sigma"),
    )
    return metrics.drop_unpredicted(rows).drop("mean", "sigma")


@query("flt5_member_subset", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 5 IN (0, 2) AND l_partkey % 3 = 1""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns({"fold": F.col("l_orderkey") % 5, "run": F.col("l_partkey") % 3})
    return splits.select_members(rows, [0, 2], [1]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("flt7_burn_in", """SELECT event_id, 'after' AS rule FROM events WHERE event_id % 50 > 10
UNION ALL SELECT event_id, 'half' FROM events WHERE event_id % 50 >= 25""")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.col("event_id") % 50).alias("epoch"))
    pick = lambda df, rule: df.select("event_id", F.lit(rule).alias("rule"))
    return pick(tuning.after_burn_in(rows, ignore_first=10), "after").unionByName(
        pick(tuning.after_burn_in(rows, n_epochs=50), "half")
    )


@query("set1_union_strings", "SELECT s, count(*) AS n FROM (SELECT p_name AS s FROM part UNION ALL SELECT text FROM documents) GROUP BY ALL")
def _(spark, sf):
    named = lambda t, c: table(spark, sf, t).select(F.col(c).alias("s"))
    return selection.all_strings(named("part", "p_name"), named("documents", "text"), text="s").groupBy("s").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("set2_append_selected", """SELECT c_name AS smiles, c_acctbal AS property FROM customer
UNION ALL SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal > 5000""")
def _(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_name").alias("smiles"), F.col("c_acctbal").alias("property"))
    extra = table(spark, sf, "supplier").where("s_acctbal > 5000").select(
        F.col("s_acctbal").alias("property"), F.col("s_name").alias("smiles")
    )
    return selection.append_rows(base, extra)


@query("set3_distinct_strings", "SELECT DISTINCT text FROM documents")
def _(spark, sf):
    return selection.distinct_strings(heavy(spark, sf, "documents"), "text")


@query("srt1_top_fraction", """SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT (SELECT ceil(count(*) * 0.35)::BIGINT FROM part)""")
def _(spark, sf):
    return selection.top_fraction(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", "p_partkey", 0.35)


@query("srt1_top_fraction_orders", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT (SELECT ceil(count(*) * 0.5)::BIGINT FROM orders)""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return selection.top_fraction(rows, "o_totalprice", "o_orderkey", 0.5)


@query("srt2_top_and_bottom", """(SELECT c_custkey, c_acctbal, 'top' AS "end" FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)
UNION ALL (SELECT c_custkey, c_acctbal, 'bottom' FROM customer ORDER BY c_acctbal, c_custkey DESC LIMIT 5)""")
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return selection.top_and_bottom(rows, "c_acctbal", "c_custkey", 5, 5)


@query("srt3_best_configuration", """SELECT l_returnflag, l_linestatus, round(score, 6) AS score FROM (SELECT l_returnflag, l_linestatus, avg(l_discount) AS score
FROM lineitem GROUP BY ALL) ORDER BY score DESC, 1, 2 LIMIT 1""")
def _(spark, sf):
    scores = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("score"))
    best = tuning.best_configuration(scores, ["l_returnflag", "l_linestatus"])
    return best.withColumn("score", F.round("score", 6))


@query("srt4_preview", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY ALL LIMIT 5")
def _(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return selection.preview(table(spark, sf, "lineitem").select(*cols), [F.col(c) for c in cols])


def accepted_sql():
    return f"""{MOLECULES_SQL}, checked AS (SELECT mol_id, smiles, {checks_sql('smiles')}, NOT regexp_matches(smiles, '[.+-]') AS neutral FROM molecules),
kept AS (SELECT mol_id, smiles FROM checked WHERE covered AND parens AND brackets AND rings AND neutral)"""


@query("agg25_acceptance", f"""WITH {accepted_sql()}, v AS (SELECT count(*) AS valid FROM checked WHERE covered AND parens AND brackets AND rings),
a AS (SELECT count(*) AS attempts FROM molecules), k AS (SELECT count(*) AS kept, count(DISTINCT smiles) AS uniq FROM kept)
SELECT attempts, valid, kept, kept - uniq AS duplicates, least(uniq, 3000)::BIGINT AS accepted, (3000 - least(uniq, 3000))::BIGINT AS shortfall FROM v, a, k""")
def _(spark, sf):
    return selection.acceptance(molecules(spark, sf), 3000)


@query("ml9_accept_candidates", f"""WITH {accepted_sql()} SELECT min(mol_id) AS cand_id, smiles FROM kept GROUP BY smiles ORDER BY 1 LIMIT 3000""")
def _(spark, sf):
    drawn = molecules(spark, sf).select(F.col("mol_id").alias("cand_id"), "smiles")
    return discovery.accept(drawn, 3000)


@query("jon7_new_tokens", f"""SELECT DISTINCT token FROM (SELECT unnest({tok('text')}) AS token FROM documents)
WHERE token NOT IN (SELECT unnest({tok('p_name')}) FROM part)""")
def _(spark, sf):
    toks = lambda t, c: vocabulary.distinct_tokens(heavy(spark, sf, t).select(tk.tokenize(F.col(c)).alias("tokens")))
    return vocabulary.new_tokens(toks("documents", "text"), toks("part", "p_name"))


@query("jon8_known_flag", f"""WITH a AS (SELECT DISTINCT unnest({tok('text')}) AS token FROM documents),
b AS (SELECT DISTINCT unnest({tok('p_name')}) AS token FROM part)
SELECT a.token, b.token IS NOT NULL AS in_train FROM a LEFT JOIN b USING (token)""")
def _(spark, sf):
    toks = lambda t, c: vocabulary.distinct_tokens(heavy(spark, sf, t).select(tk.tokenize(F.col(c)).alias("tokens")))
    return vocabulary.flag_known(toks("documents", "text"), toks("part", "p_name"))


@query("win1_ordinal", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS ordinal FROM lineitem")
def _(spark, sf):
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf, "lineitem").select(*ids, "l_extendedprice")
    return ordinal(rows, [F.col("l_extendedprice").desc(), *[F.col(c) for c in ids]]).drop("l_extendedprice")


@query("win1_ordinal_keyed", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch FROM events")
def _(spark, sf):
    return history(spark, sf).select("event_id", "user_id", "epoch")


def history(spark, sf):
    """Events as a training history: run = user, epoch = order in time."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return ordinal(rows, [F.col("ts"), F.col("event_id")], ["user_id"], name="epoch")
