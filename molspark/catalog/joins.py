"""Lookups, ensemble scoring, similarity and interpretation."""

from __future__ import annotations

from pyspark.sql import functions as F

from molspark.catalog.base import (
    STRUCTURAL_SQL,
    heavy, MOLECULES_SQL, bits_sql, body, grams, hexint, molecules, query, r6, set_sql, table, tok,
)
from molspark.functions import tokens as tk
from molspark.functions.hashing import fingerprint, fragment_id, gram_set
from molspark.operators import accessibility, augment, ensemble, families, interpret, scaling, similarity, vocabulary
from molspark.operators.selection import top_fraction
from molspark.operators.shaping import unnest
from molspark.plans import discovery
from molspark.staging import stage

# --- linear members over encoded tokens -----------------------------------

FOLDS, RUNS = 2, 2


def linear_score(df):
    """Position-weighted sum of a fixed weight per token id and member."""
    weight = lambda i: (i * 7 + F.col("fold") * 3 + F.col("run")) % 11
    terms = F.transform(
        F.col("ids"), lambda i, p: F.when(i > 0, weight(i) * (p + 1)).otherwise(0)
    )
    pred = F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, x: a + x) / 100.0
    return ensemble.score_expression(df, pred)


def encoded_variants(spark, sf):
    """Part names as encoded rotation variants."""
    part = heavy(spark, sf, "part").select(
        F.col("p_partkey").alias("src_id"), augment.rotation_variants(F.col("p_name")).alias("variants")
    )
    rows = augment.explode_variants(part).select("src_id", "variant_no", tk.tokenize(F.col("variant")).alias("tokens"))
    vocab = stage(vocabulary.build_vocabulary(
        table(spark, sf, "part").select(tk.tokenize(F.col("p_name")).alias("tokens"))
    ), "vocabulary")
    keyed = rows.withColumn("_row", F.concat_ws("|", "src_id", "variant_no"))
    return vocabulary.encode(keyed, vocab, None, "_row").select("src_id", "variant_no", "ids")


_LINEAR = f"""voc AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS id FROM (SELECT DISTINCT unnest({tok('p_name')}) AS token FROM part)),
rot AS (SELECT DISTINCT p_partkey, list_concat(t[k + 1:], t[:k]) AS t FROM
 (SELECT p_partkey, t, unnest(range(len(t))) AS k FROM (SELECT p_partkey, {body('p_name')} AS t FROM part))),
toks AS (SELECT p_partkey, list_concat([' '], t, [' ']) AS t FROM rot UNION ALL SELECT p_partkey, [' ', ' '] FROM part WHERE len({body('p_name')}) = 0),
vars AS (SELECT *, row_number() OVER () AS v FROM toks),
pos AS (SELECT p_partkey, v, unnest(t) AS token, unnest(range(len(t))) - len(t) + (SELECT max(len(t)) + 1 FROM vars) AS p FROM vars),
members AS (SELECT f, r FROM (SELECT unnest(range({FOLDS})) AS f), (SELECT unnest(range({RUNS})) AS r)),
preds AS (SELECT p_partkey, v, f, r, sum(((id * 7 + f * 3 + r) % 11) * (p + 1)) / 100.0::DOUBLE AS pred
 FROM pos JOIN voc USING (token), members WHERE p >= 0 GROUP BY ALL)"""


@query("flagship_rank_parts", f"""WITH {_LINEAR}, a AS (SELECT p_partkey, avg(pred) AS m, stddev_pop(pred) AS s FROM preds GROUP BY 1)
SELECT p_partkey, p_name, round(m, 6) AS mean, round(s, 6) AS sigma FROM a JOIN part USING (p_partkey)
ORDER BY round(m, 6) DESC, p_partkey LIMIT (SELECT ceil(count(*) * 0.5)::BIGINT FROM part)""")
def flagship(spark, sf):
    preds = ensemble.infer(encoded_variants(spark, sf), linear_score, FOLDS, RUNS)
    preds = stage(preds.select("src_id", r6(F.col("mean"), "mean"), r6(F.col("sigma"), "sigma")), "predictions")
    best = top_fraction(preds, "mean", "src_id", 0.5)
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("src_id"), "p_name")
    return ensemble.attach(best, names).select(F.col("src_id").alias("p_partkey"), "p_name", "mean", "sigma")


@query("ml2_infer_unscaled", f"""WITH {_LINEAR}, sc AS (SELECT p_partkey % 2 AS f, quantile_cont(p_retailprice, 0.5) AS c,
 quantile_cont(p_retailprice, 0.95) - quantile_cont(p_retailprice, 0.05) AS w FROM part GROUP BY 1)
SELECT p_partkey, p_name, round(avg(pred * w + c), 6) AS mean, round(stddev_pop(pred * w + c), 6) AS sigma
FROM preds JOIN sc USING (f) JOIN part USING (p_partkey) GROUP BY ALL""")
def _(spark, sf):
    part = table(spark, sf, "part")
    rows = part.select((F.col("p_partkey") % 2).cast("int").alias("fold"), "p_retailprice")
    scaler = stage(scaling.fit_robust(rows, "p_retailprice"), "scaler")
    preds = ensemble.infer(encoded_variants(spark, sf), linear_score, FOLDS, RUNS, scaler)
    base = part.select(F.col("p_partkey").alias("src_id"), "p_name")
    out = ensemble.attach(base, preds)
    return out.select(F.col("src_id").alias("p_partkey"), "p_name", r6(F.col("mean"), "mean"), r6(F.col("sigma"), "sigma"))


@query("udf2_batch_scorer", """SELECT doc_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sigma FROM (SELECT doc_id, n_chars * 0.01::DOUBLE + f + r * 0.5::DOUBLE AS x
FROM documents, (SELECT unnest([0, 1, 2]) AS f), (SELECT unnest([0, 1]) AS r)) GROUP BY 1""")
def _(spark, sf):
    docs = heavy(spark, sf, "documents").select(F.col("doc_id").alias("src_id"), "n_chars")
    score = lambda df: ensemble.score_batches(df, lambda b: b["n_chars"] * 0.01 + b["fold"] + b["run"] * 0.5)
    out = ensemble.infer(docs, score, 3, 2)
    return out.select(F.col("src_id").alias("doc_id"), r6(F.col("mean"), "mean"), r6(F.col("sigma"), "sigma"))


@query("jon5_members", """SELECT o_orderkey, f AS fold, r AS run FROM orders, (SELECT unnest([0, 1, 2]) AS f), (SELECT unnest([0, 1]) AS r)""")
def _(spark, sf):
    return ensemble.expand_members(table(spark, sf, "orders").select("o_orderkey"), 3, 2)


@query("agg1_mean_sigma", "SELECT l_orderkey, round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS sigma FROM lineitem GROUP BY 1")
def _(spark, sf):
    out = ensemble.mean_sigma(table(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice")
    return out.select("l_orderkey", r6(F.col("mean"), "mean"), r6(F.col("sigma"), "sigma"))


def _order_means(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "row_id")
    out = ensemble.mean_sigma(rows, "row_id", "l_discount")
    return out.select("row_id", r6(F.col("mean"), "mean"), r6(F.col("sigma"), "sigma"))


_ORDER_MEANS = "m AS (SELECT l_orderkey, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS sigma FROM lineitem GROUP BY 1)"
# Every seventh order goes by a key that no line has.
_ROW_ID = "CASE WHEN o_orderkey % 7 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END"


@query("jon3_write_back", f"WITH {_ORDER_MEANS} SELECT {_ROW_ID} AS row_id, o_totalprice, mean, sigma FROM orders LEFT JOIN m ON {_ROW_ID} = l_orderkey")
def _(spark, sf):
    base = table(spark, sf, "orders").select(F.expr(_ROW_ID).alias("row_id"), "o_totalprice")
    return ensemble.write_back(base, _order_means(spark, sf))


@query("jon4_attach", f"WITH {_ORDER_MEANS} SELECT {_ROW_ID} AS row_id, o_orderpriority AS smiles, mean, sigma FROM orders LEFT JOIN m ON {_ROW_ID} = l_orderkey")
def _(spark, sf):
    base = table(spark, sf, "orders").select(F.expr(_ROW_ID).alias("row_id"), F.col("o_orderpriority").alias("smiles"))
    return ensemble.attach(base, _order_means(spark, sf), "row_id")


# --- accessibility ---------------------------------------------------------

_FRAGS = f"""cnt AS (SELECT doc_id, {hexint('md5(g)')} AS fragment_id, count(*) AS cnt FROM
 (SELECT doc_id, unnest({grams(tok('text'), 2)}) AS g FROM documents) GROUP BY ALL),
contrib AS (SELECT DISTINCT fragment_id, (fragment_id % 1000) / 250.0::DOUBLE - 2 AS score FROM cnt WHERE fragment_id % 3 <> 0),
joined AS (SELECT doc_id, cnt.fragment_id, cnt, coalesce(score, -4) AS score FROM cnt LEFT JOIN contrib USING (fragment_id))"""


def doc_fragments(spark, sf):
    """Counts per document and a contribution table made from a part of them."""
    docs = heavy(spark, sf, "documents")
    counts = stage(
        accessibility.fragment_counts(docs, "doc_id", tk.ngrams(tk.tokenize(F.col("text")), 2)), "fragments"
    )
    return counts, contributions(counts)


def contributions(counts):
    frag = F.col("fragment_id")
    return stage(
        counts.select("fragment_id").distinct().where(frag % 3 != 0).withColumn("score", frag % 1000 / 250.0 - 2),
        "contributions",
    )


@query("jon2_fragment_lookup", f"WITH {_FRAGS} SELECT doc_id, fragment_id, cnt, round(score, 6) AS score FROM joined")
def _(spark, sf):
    out = accessibility.with_scores(*doc_fragments(spark, sf))
    return out.select("doc_id", "fragment_id", "cnt", r6(F.col("score"), "score"))


@query("agg4_fragment_score", f"WITH {_FRAGS} SELECT doc_id, round(sum(score * cnt) / sum(cnt), 9) AS fragment_score, count(*)::INT AS n_bits FROM joined GROUP BY 1")
def _(spark, sf):
    out = accessibility.fragment_score(*doc_fragments(spark, sf), "doc_id")
    return out.select("doc_id", F.round("fragment_score", 9).alias("fragment_score"), "n_bits")


_SA = f"""{MOLECULES_SQL},
mt AS (SELECT mol_id, {tok('smiles')} AS t FROM molecules),
feat AS (SELECT mol_id, len(a) AS n_atoms, len(list_filter(a, lambda x: contains(x, '@'))) AS n_chiral FROM
 (SELECT mol_id, list_filter(t, lambda x: x NOT IN ({STRUCTURAL_SQL}, ' ') AND NOT regexp_matches(x, '^%?[0-9]+$')) AS a FROM mt)),
cnt AS (SELECT mol_id, {hexint('md5(g)')} AS fragment_id, count(*) AS cnt FROM (SELECT mol_id, unnest({grams('t', 2)}) AS g FROM mt) GROUP BY ALL),
contrib AS (SELECT DISTINCT fragment_id, (fragment_id % 1000) / 250.0::DOUBLE - 2 AS score FROM cnt WHERE fragment_id % 3 <> 0),
fs AS (SELECT mol_id, sum(coalesce(score, -4) * cnt) / sum(cnt) AS s, count(*) AS n_bits FROM cnt LEFT JOIN contrib USING (fragment_id) GROUP BY 1),
raw AS (SELECT mol_id, n_atoms, 11 - (s - (pow(n_atoms, 1.005) - n_atoms) - log10(n_chiral + 1)
 + CASE WHEN n_atoms > n_bits THEN 0.5 * ln(n_atoms::DOUBLE / n_bits) ELSE 0 END + 4 + 1) / 6.5 * 9 AS x FROM feat JOIN fs USING (mol_id)),
sa AS (SELECT mol_id, CASE WHEN n_atoms > 0 THEN greatest(1, least(10, CASE WHEN x > 8 THEN 8 + ln(x - 8) ELSE x END)) END AS sa_score FROM raw)"""


def molecule_scorer(spark, sf):
    """Accessibility scorer with contributions from the molecules' own fragments."""
    mols = molecules(spark, sf)
    ids = F.transform(F.array_distinct(tk.ngrams(tk.tokenize(F.col("smiles")), 2)), fragment_id)
    return discovery.accessibility_scorer(contributions(unnest(mols, [], ids, "fragment_id")))  # made from the different fragments alone


def _molecule_scores(spark, sf):
    cands = molecules(spark, sf).withColumnRenamed("mol_id", "cand_id")
    return molecule_scorer(spark, sf)(cands).withColumnRenamed("cand_id", "mol_id")


@query("agg5_accessibility", f"WITH {_SA} SELECT mol_id, round(sa_score, 6) AS sa_score FROM sa")
def _(spark, sf):
    return _molecule_scores(spark, sf).select("mol_id", r6(F.col("sa_score"), "sa_score"))


@query("agg6_score_gate", f"""WITH {_SA} SELECT count(*) AS n, round(avg(sa_score), 6) AS avg_score, avg(sa_score) > 5 AND count(*) > 0 AS stop FROM sa""")
def _(spark, sf):
    out = accessibility.gate(_molecule_scores(spark, sf))
    return out.select("n", r6(F.col("avg_score"), "avg_score"), "stop")


# --- similarity ------------------------------------------------------------

def pairs_sql(fp: str, threshold: float, prefix: str = "") -> str:
    """Values from a threshold with their pair counts, and all pairs below under a null, for a table ``fp(id, bits)``."""
    p = prefix
    return f"""{p}b AS (SELECT id, len(bits) AS n, unnest(bits) AS bit FROM {fp}),
{p}ov AS (SELECT x.id AS i, y.id AS j, any_value(x.n) AS ni, any_value(y.n) AS nj, count(*) AS c FROM {p}b x JOIN {p}b y ON x.bit = y.bit AND x.id < y.id GROUP BY ALL),
{p}above AS (SELECT c / (ni + nj - c) AS sim, count(*) AS n_pairs FROM {p}ov WHERE c / (ni + nj - c) >= {threshold} GROUP BY 1),
{p}dist AS (SELECT * FROM {p}above UNION ALL SELECT * FROM (SELECT NULL::DOUBLE AS sim,
 (SELECT count(*) * (count(*) - 1) // 2 FROM {fp}) - (SELECT coalesce(sum(n_pairs), 0) FROM {p}above) AS n_pairs) WHERE n_pairs > 0)"""


def text_sets(df, key, text="text"):
    """Sets of hashed token runs, which the operators write once."""
    return df.select(F.col(key).alias("id"), gram_set(F.col(text), 8).alias("bits"))


@query("jon6_similarity_distribution", f"""WITH fp AS (SELECT doc_id AS id, {set_sql(tok('text'))} AS bits FROM documents), {pairs_sql('fp', 0.5)}
SELECT round(sim, 9) AS sim, n_pairs::BIGINT AS n_pairs FROM dist""")
def _(spark, sf):
    out = similarity.similarity_distribution(text_sets(heavy(spark, sf, "documents"), "doc_id"), "id", 0.5)
    return out.select(F.round("sim", 9).alias("sim"), "n_pairs")


@query("jon6_similarity_distribution_short", f"""WITH fp AS (SELECT o_orderkey AS id, {bits_sql(tok('o_orderpriority'))} AS bits FROM orders),
g AS (SELECT bits, count(*) AS m, row_number() OVER () AS id FROM fp GROUP BY bits),
p AS (SELECT x.bits AS a, y.bits AS b, CASE WHEN x.id = y.id THEN x.m * (x.m - 1) // 2 ELSE x.m * y.m END AS n FROM g x JOIN g y ON x.id <= y.id),
s AS (SELECT len(list_intersect(a, b)) AS c, len(a) + len(b) - len(list_intersect(a, b)) AS t, n FROM p),
v AS (SELECT CASE WHEN t > 0 AND c / t >= 0.1 THEN c / t END AS sim, n FROM s WHERE n > 0)
SELECT round(sim, 9) AS sim, sum(n)::BIGINT AS n_pairs FROM v GROUP BY 1""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), fingerprint(tk.ngrams(tk.tokenize(F.col("o_orderpriority")), 2)).alias("bits"))
    out = similarity.similarity_distribution(rows, "id", 0.1)
    return out.select(F.round("sim", 9).alias("sim"), "n_pairs")


@query("jon9_similar_fingerprints", f"""WITH fp AS (SELECT min(doc_id) AS id, count(*) AS m, bits FROM (SELECT doc_id, {set_sql(tok('text'))} AS bits FROM documents) GROUP BY bits),
{pairs_sql('fp', 0.8)} SELECT i AS rep_a, j AS rep_b, x.m AS m_a, y.m AS m_b, round(c / (ni + nj - c), 6) AS sim FROM ov JOIN fp x ON x.id = i JOIN fp y ON y.id = j
WHERE c / (ni + nj - c) >= 0.8""")
def _(spark, sf):
    out = similarity.similar_fingerprints(text_sets(heavy(spark, sf, "documents"), "doc_id"), "id", 0.8)
    return out.withColumn("sim", F.round("sim", 6))


_CLASSES = f"""fp AS (SELECT min(doc_id) AS id, count(*) AS m, bits FROM (SELECT doc_id, {set_sql(tok('text'))} AS bits FROM documents) GROUP BY bits),
{pairs_sql('fp', 0.8)}, links AS (SELECT i, j FROM ov WHERE c / (ni + nj - c) >= 0.8),
ways AS (SELECT i, j FROM links UNION ALL SELECT j, i FROM links),
reach AS (SELECT id, id AS other FROM fp UNION SELECT reach.id, ways.j FROM reach JOIN ways ON ways.i = reach.other),
label AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id)"""


@query("jon9_similarity_classes", f"""WITH RECURSIVE {_CLASSES}, n AS (SELECT class_id, count(*) AS n_links FROM links JOIN label ON id = i GROUP BY class_id)
SELECT class_id, first(id ORDER BY m DESC, id) AS rep, sum(m)::BIGINT AS n_rows, count(*) AS n_sets, coalesce(any_value(n_links), 0)::BIGINT AS n_links
FROM label JOIN fp USING (id) LEFT JOIN n USING (class_id) GROUP BY class_id""")
def _(spark, sf):
    return families.similarity_families(text_sets(heavy(spark, sf, "documents"), "doc_id"), "id", 0.8)[1]


@query("jon9_class_members", f"""WITH RECURSIVE {_CLASSES}, rows AS (SELECT doc_id, {set_sql(tok('text'))} AS bits FROM documents)
SELECT doc_id, class_id FROM rows JOIN fp USING (bits) JOIN label USING (id)""")
def _(spark, sf):
    members, _ = families.similarity_families(text_sets(heavy(spark, sf, "documents"), "doc_id"), "id", 0.8)
    return members.withColumnRenamed("id", "doc_id")


@query("jon9_banded_pairs", f"""WITH fp AS (SELECT min(doc_id) AS id, count(*) AS m, bits FROM (SELECT doc_id, {set_sql(tok('text'))} AS bits FROM documents) GROUP BY bits),
{pairs_sql('fp', 0.8)} SELECT i AS rep_a, j AS rep_b, x.m AS m_a, y.m AS m_b, round(c / (ni + nj - c), 6) AS sim FROM ov JOIN fp x ON x.id = i JOIN fp y ON y.id = j
WHERE c / (ni + nj - c) >= 0.8""")
def _(spark, sf):
    out = families.banded_pairs(text_sets(heavy(spark, sf, "documents"), "doc_id"), "id", 0.8)
    return out.withColumn("sim", F.round("sim", 6))


# --- interpretation --------------------------------------------------------

@query("agg20_attention_stats", """SELECT l_orderkey AS "row", l_linenumber AS pos, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS std FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("pos"), F.col("l_discount").alias("weight")
    )
    out = interpret.attention_stats(rows)
    return out.select("row", "pos", r6(F.col("mean"), "mean"), r6(F.col("std"), "std"))


@query("ml12_atom_weights", f"""WITH {MOLECULES_SQL}, t AS (SELECT mol_id, {body('smiles')} AS t FROM molecules),
a AS (SELECT mol_id, (unnest(range(len(t))))::INT AS pos, unnest(t) AS token, ((mol_id + 39 - len(t) + unnest(range(len(t)))) % 17)::DOUBLE AS weight FROM t),
f AS (SELECT * FROM a WHERE token NOT IN ({STRUCTURAL_SQL}) AND NOT regexp_matches(token, '^[0-9]+$'))
SELECT *, round(CASE WHEN max(weight) OVER w = min(weight) OVER w THEN 0 ELSE (weight - min(weight) OVER w) / (max(weight) OVER w - min(weight) OVER w) END, 6) AS norm_weight
FROM f WINDOW w AS (PARTITION BY mol_id)""")
def _(spark, sf):
    rows = molecules(spark, sf).select(
        "mol_id", tk.tokenize(F.col("smiles")).alias("tokens"),
        F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: ((F.col("mol_id") + i) % 17).cast("double")).alias("weights"),
    )
    out = interpret.normalised_atom_weights(interpret.aligned_tokens(rows, "mol_id"), "mol_id")
    return out.withColumn("norm_weight", F.round("norm_weight", 6))


@query("scl10_relative_path", f"""WITH t AS (SELECT p_partkey, {body('p_name')} AS t FROM part),
p AS (SELECT p_partkey, (unnest(range(len(t))))::INT AS pos, array_to_string(t[:unnest(range(len(t))) + 1], '') AS prefix FROM t),
s AS (SELECT p_partkey, pos, ({hexint('md5(prefix)')} % 1000) / 100.0::DOUBLE - 5.005 AS pred FROM p),
r AS (SELECT p_partkey, pos, (pred - last_value(pred) OVER w) / abs(last_value(pred) OVER w) AS d FROM s
 WINDOW w AS (PARTITION BY p_partkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT p_partkey, pos, round(d, 6) AS rel_diff, round(max(d) OVER (PARTITION BY p_partkey), 6) AS max_rel_diff FROM r""")
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", tk.tokenize(F.col("p_name")).alias("tokens"))
    preds = interpret.prefix_rows(part, "p_partkey").withColumn("pred", fragment_id(F.col("prefix")) % 1000 / 100.0 - 5.005)
    out = interpret.relative_to_last(preds, "p_partkey")
    return out.select("p_partkey", "pos", r6(F.col("rel_diff"), "rel_diff"), r6(F.col("max_rel_diff"), "max_rel_diff"))


@query("win8_softmax_pooling", """WITH e AS (SELECT label, exp((vec_id % 7) / 2.0::DOUBLE) AS w, embedding FROM embeddings),
x AS (SELECT label, w, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS dim FROM e)
SELECT label, dim::INT AS dim, round(sum(w * v) / sum(w), 6) AS pooled FROM x GROUP BY label, dim""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 7 / 2.0).alias("logit"), "embedding")
    out = interpret.softmax_pooling(rows, "label", "logit", "embedding")
    return out.select("label", "dim", r6(F.col("pooled"), "pooled"))


@query("ml5_pca")
def _(spark, sf):
    return interpret.project_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")


@query("ml6_clusters")
def _(spark, sf):
    return interpret.cluster_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding", 10)
