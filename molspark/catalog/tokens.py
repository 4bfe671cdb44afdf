"""Token, variant and string-form queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from molspark.catalog.base import (
    STRUCTURAL_SQL,
    heavy, MOLECULES_SQL, bits_sql, body, grams, hexint, joined, list_text, molecules, query, r6, table, tok,
)
from molspark.functions import scores, tokens as tk, validity
from molspark.functions.hashing import fingerprint
from molspark.operators import accessibility, augment, interpret, selection, shaping, vocabulary
from molspark.staging import stage


@query("scl1_tokenize", f"SELECT doc_id, {list_text(tok('text'))} AS tokens FROM documents")
def _(spark, sf):
    return heavy(spark, sf, "documents").select("doc_id", joined(tk.tokenize(F.col("text")), "tokens"))


@query("scl1_tokenize_strict", f"""SELECT doc_id, len(regexp_extract_all(text, '{tk.STRICT_TOKEN_PATTERN}', 1))::INT AS n
FROM documents""")
def _(spark, sf):
    return heavy(spark, sf, "documents").select("doc_id", F.size(tk.body_tokens(F.col("text"), True)).alias("n"))


@query("scl2_ngrams", f"""WITH {MOLECULES_SQL}, t AS (SELECT mol_id, {tok('smiles')} AS k FROM molecules)
SELECT mol_id, {list_text(grams('k', 2))} AS g2, {list_text(grams('k', 3))} AS g3 FROM t""")
def _(spark, sf):
    t = molecules(spark, sf).withColumn("k", tk.tokenize(F.col("smiles")))
    return t.select("mol_id", joined(tk.ngrams(F.col("k"), 2), "g2"), joined(tk.ngrams(F.col("k"), 3), "g3"))


_VOCAB = f"""vocab AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS token_id FROM
 (SELECT DISTINCT unnest({tok('text')}) AS token FROM documents))"""


@query("agg2_vocabulary", f"""WITH {_VOCAB} SELECT token, token_id::INT AS token_id FROM vocab
UNION ALL SELECT 'pad', 0 UNION ALL SELECT 'unk', 1""")
def _(spark, sf):
    docs = heavy(spark, sf, "documents").select(tk.tokenize(F.col("text")).alias("tokens"))
    return vocabulary.build_vocabulary(docs)


@query("agg3_max_length", f"SELECT max(len({tok('text')}))::INT AS max_length FROM documents")
def _(spark, sf):
    return vocabulary.max_length(heavy(spark, sf, "documents").select(tk.tokenize(F.col("text")).alias("tokens")))


_ENCODED = f"""WITH {MOLECULES_SQL}, v AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS token_id FROM
 (SELECT DISTINCT unnest({tok('smiles')}) AS token FROM molecules WHERE custkey % 5 = 0)),
m AS (SELECT map(list(token), list(token_id)) AS m FROM v),
e AS (SELECT mol_id, list_transform({tok('smiles')}, lambda x: coalesce(m[x], 1)) AS i FROM molecules, m),
f AS (SELECT mol_id, list_concat(list_transform(range((SELECT max(len(i)) + 1 FROM e) - len(i)), lambda q: 0), i) AS ids FROM e)"""


def _encoded_parts(spark, sf, how):
    mols = molecules(spark, sf).select("mol_id", tk.tokenize(F.col("smiles")).alias("tokens"))
    vocab = vocabulary.build_vocabulary(molecules(spark, sf).where("custkey % 5 = 0").select(tk.tokenize(F.col("smiles")).alias("tokens")))
    return how(mols, stage(vocab, "vocabulary"), None, "mol_id")


@query("scl3_encode", f"{_ENCODED} SELECT mol_id, {list_text('ids')} AS ids FROM f")
def _(spark, sf):
    return _encoded_parts(spark, sf, vocabulary.encode).select("mol_id", joined(F.col("ids"), "ids"))


@query("scl3_encode_by_join", f"{_ENCODED} SELECT mol_id, {list_text('ids')} AS ids FROM f")
def _(spark, sf):
    return _encoded_parts(spark, sf, vocabulary.encode_by_join).select("mol_id", joined(F.col("ids"), "ids"))


@query("jon1_token_lookup", f"""WITH known AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS token_id FROM
 (SELECT DISTINCT unnest({tok('text')}) AS token FROM benchmark)),
t AS (SELECT doc_id, unnest({tok('text')}) AS token FROM documents)
SELECT doc_id, coalesce(token_id, 1)::INT AS token_id, count(*) AS n FROM t LEFT JOIN known USING (token) GROUP BY ALL""")
def _(spark, sf):
    docs = heavy(spark, sf, "documents").select("doc_id", tk.tokenize(F.col("text")).alias("tokens"))
    bench = table(spark, sf, "benchmark").select(tk.tokenize(F.col("text")).alias("tokens"))
    known = stage(vocabulary.build_vocabulary(bench), "vocabulary")
    return vocabulary.lookup_tokens(docs, known).groupBy("doc_id", "token_id").agg(F.count(F.lit(1)).alias("n"))


# Every document with bracket tokens of its own, so that there are far more than a map literal takes.
_MANY = "concat('[', CAST(doc_id % 5000 AS STRING), ']', text, '[', CAST(doc_id % 977 AS STRING), 'H]')"


@query("scl4_dictionaries", f"""WITH t AS (SELECT doc_id, {tok(_MANY)} AS t FROM documents),
v AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS token_id FROM (SELECT DISTINCT unnest(t) AS token FROM t))
SELECT doc_id, token, token_id::INT AS token_id, token AS back, count(*) AS n FROM (SELECT doc_id, unnest(t) AS token FROM t) JOIN v USING (token) GROUP BY ALL""")
def _(spark, sf):
    docs = heavy(spark, sf, "documents").select("doc_id", tk.tokenize(F.expr(_MANY)).alias("tokens"))
    vocab = stage(vocabulary.build_vocabulary(docs), "vocabulary")
    ids = vocabulary.lookup_tokens(docs, vocab).groupBy("doc_id", "token", "token_id").agg(F.count("*").alias("n"))
    back = vocab.select("token_id", F.col("token").alias("back"))
    return ids.join(back, "token_id").select("doc_id", "token", "token_id", "back", "n")


@query("scl5_decode", f"SELECT doc_id, array_to_string({body(_MANY)}, '') AS decoded FROM documents")
def _(spark, sf):
    docs = heavy(spark, sf, "documents").select("doc_id", tk.tokenize(F.expr(_MANY)).alias("tokens"))
    vocab = stage(vocabulary.build_vocabulary(docs), "vocabulary")
    return vocabulary.decode(_ids_of(docs, vocab), vocab, "doc_id").select("doc_id", "decoded")


def _ids_of(docs, vocab):
    """Ids of every token, as many as a row has."""
    pairs = vocabulary.lookup_tokens(docs, vocab).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token_id"))).alias("p"))
    return pairs.select("doc_id", F.col("p.token_id").alias("ids"))


@query("scl5_decode_names", f"WITH {MOLECULES_SQL} SELECT mol_id, array_to_string({body('smiles')}, '') AS decoded FROM molecules")
def _(spark, sf):
    mols = molecules(spark, sf).select("mol_id", tk.tokenize(F.col("smiles")).alias("tokens"))
    vocab = stage(vocabulary.build_vocabulary(mols), "vocabulary")
    coded = vocabulary.encode(mols, vocab, None, "mol_id")
    return vocabulary.decode(coded, vocab, "mol_id").select("mol_id", "decoded")


@query("scl6_rotate", f"""WITH {MOLECULES_SQL}, t AS (SELECT mol_id, {tok('smiles')} AS t, (mol_id % 13)::INT % len({tok('smiles')}) AS k FROM molecules)
SELECT mol_id, array_to_string(list_concat(t[k + 1:], t[:k]), '') AS rotated FROM t""")
def _(spark, sf):
    mols = molecules(spark, sf).withColumn("t", tk.tokenize(F.col("smiles")))
    by = (F.col("mol_id") % 13).cast("int")
    return mols.select("mol_id", F.array_join(tk.rotate(F.col("t"), by), "").alias("rotated"))


_ROTATIONS = f"""r AS (SELECT mol_id, unnest(range(len(t))) AS k, t FROM (SELECT mol_id, {body('smiles')} AS t FROM molecules)),
d AS (SELECT mol_id, array_to_string(list_concat(t[k + 1:], t[:k]), '') AS variant, min(k) AS first FROM r GROUP BY ALL),
v AS (SELECT mol_id, (row_number() OVER (PARTITION BY mol_id ORDER BY first) - 1)::INT AS variant_no, variant FROM d
 UNION ALL SELECT mol_id, 0, '' FROM molecules WHERE len({body('smiles')}) = 0)"""


@query("scl7_rotation_variants", f"WITH {MOLECULES_SQL}, {_ROTATIONS} SELECT * FROM v")
def _(spark, sf):
    mols = molecules(spark, sf).select("mol_id", augment.rotation_variants(F.col("smiles")).alias("variants"))
    return augment.explode_variants(mols)


@query("scl8_two_forms", f"""SELECT p_partkey, array_to_string(CASE WHEN len(f) = 0 THEN [p_name] ELSE f END, '~') AS forms FROM
(SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN [] WHEN upper(p_type) = p_type THEN [p_type] ELSE [upper(p_type), p_type] END AS f FROM part)""")
def _(spark, sf):
    part = table(spark, sf, "part")
    parses = F.col("p_partkey") % 3 != 0
    forms = tk.two_forms(
        F.col("p_name"), F.when(parses, F.upper("p_type")), F.when(parses, F.col("p_type")), F.when(parses, F.upper("p_type"))
    )
    return part.select("p_partkey", joined(forms, "forms"))


@query("scl9_prefixes", f"""WITH {MOLECULES_SQL}, t AS (SELECT mol_id, {body('smiles')} AS t FROM molecules)
SELECT mol_id, (unnest(range(len(t))))::INT AS pos, array_to_string(t[:unnest(range(len(t))) + 1], '') AS prefix FROM t""")
def _(spark, sf):
    mols = molecules(spark, sf).select("mol_id", tk.tokenize(F.col("smiles")).alias("tokens"))
    return interpret.prefix_rows(mols, "mol_id")


@query("scl11_precision", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN v = 0 THEN '0.3'
WHEN log10(abs(v)) >= 3 THEN '1.0' WHEN log10(abs(v)) > 0 THEN '1.' || (3 - floor(log10(abs(v))))::INT::VARCHAR
ELSE '0.' || (abs(floor(log10(abs(v)))) + 3)::INT::VARCHAR END AS fmt
FROM (SELECT *, l_discount * l_discount * l_extendedprice / 10 AS v FROM lineitem)""")
def _(spark, sf):
    v = F.col("l_discount") * F.col("l_discount") * F.col("l_extendedprice") / 10
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scores.display_precision(v, 4).alias("fmt")
    )


@query("scl12_complexity", """SELECT p_partkey, round(-((pow(a, 1.005) - a) + log10(p_partkey % 4 + 1) + log10(p_partkey % 3 + 1)
 + log10(p_partkey % 2 + 1) + CASE WHEN p_partkey % 7 = 0 THEN log10(2.0) ELSE 0 END), 6) AS penalty,
 round(CASE WHEN a > p_partkey % 37 + 1 THEN 0.5 * ln(a / (p_partkey % 37 + 1)) ELSE 0 END, 6) AS bonus
FROM (SELECT *, p_size::DOUBLE AS a FROM part)""")
def _(spark, sf):
    k = F.col("p_partkey")
    penalty = scores.complexity(F.col("p_size"), k % 4, k % 3, k % 2, (k % 7 == 0).cast("int"))
    return table(spark, sf, "part").select(
        "p_partkey", r6(penalty, "penalty"), r6(scores.symmetry_bonus(F.col("p_size"), k % 37 + 1), "bonus")
    )


@query("scl13_rescale", """SELECT o_orderkey, round(greatest(1, least(10, CASE WHEN s > 8 THEN 8 + ln(s - 8) ELSE s END)), 6) AS score,
round(greatest(1, least(10, s)), 6) AS plain FROM
(SELECT o_orderkey, 11 - (o_totalprice / 50000 - 6 + 4 + 1) / 6.5 * 9 AS s FROM orders)""")
def _(spark, sf):
    raw = F.col("o_totalprice") / 50000 - 6
    return table(spark, sf, "orders").select(
        "o_orderkey", r6(scores.rescale_score(raw), "score"), r6(scores.rescale_score(raw, smooth=False), "plain")
    )


@query("scl14_fingerprint", f"SELECT doc_id, {list_text(bits_sql(tok('text')))} AS bits FROM documents")
def _(spark, sf):
    bits = fingerprint(tk.ngrams(tk.tokenize(F.col("text")), 2))
    return heavy(spark, sf, "documents").select("doc_id", joined(bits, "bits"))


@query("scl15_fragment_counts", f"""SELECT doc_id, {hexint('md5(g)')} AS fragment_id, count(*) AS cnt FROM
(SELECT doc_id, unnest({grams(tok('text'), 2)}) AS g FROM documents) GROUP BY ALL""")
def _(spark, sf):
    docs = heavy(spark, sf, "documents")
    return accessibility.fragment_counts(docs, "doc_id", tk.ngrams(tk.tokenize(F.col("text")), 2))


@query("scl16_binary_class", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_discount * 10 > 0.5)::INT AS cls FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scores.binary_class(F.col("l_discount") * 10).alias("cls")
    )


@query("scl18_align_weights", f"""WITH {MOLECULES_SQL}, t AS (SELECT mol_id, {body('smiles')} AS t FROM molecules)
SELECT mol_id, (unnest(range(len(t))))::INT AS pos, unnest(t) AS token,
(mol_id % 10 + 29 - len(t) + unnest(range(len(t))))::DOUBLE AS weight FROM t""")
def _(spark, sf):
    mols = molecules(spark, sf).select(
        "mol_id", tk.tokenize(F.col("smiles")).alias("tokens"),
        F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: (F.col("mol_id") % 10 + i).cast("double")).alias("weights"),
    )
    return interpret.aligned_tokens(mols, "mol_id")


@query("prj5_join_strings", """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, p_brand,
 CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END], lambda x: x <> ''), 'j') AS smiles FROM part""")
def _(spark, sf):
    blank = lambda c, k: F.when(F.col("p_partkey") % k == 0, "").otherwise(F.col(c))
    return table(spark, sf, "part").select(
        "p_partkey", tk.join_strings(F.array(blank("p_name", 3), F.col("p_brand"), blank("p_type", 4))).alias("smiles")
    )


@query("prj6_explode_variants", f"""WITH {MOLECULES_SQL}, {_ROTATIONS} SELECT mol_id, variant_no, variant, property, custkey
FROM v JOIN molecules USING (mol_id)""")
def _(spark, sf):
    mols = molecules(spark, sf).select(
        "mol_id", "property", "custkey", augment.rotation_variants(F.col("smiles")).alias("variants")
    )
    return augment.explode_variants(mols)


def _some_null(spark, sf):
    bad = F.col("o_orderkey") % 10 == 0
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 21 == 0, F.array().cast("array<string>")).otherwise(
            F.array("o_orderstatus", F.when(~bad, F.col("o_orderpriority")))
        ).alias("variants"),
    )


@query("prj7_rejected_split", """SELECT o_orderkey, NOT (o_orderkey % 10 = 0 OR o_orderkey % 21 = 0) AS usable FROM orders""")
def _(spark, sf):
    good, bad = augment.split_rejected(_some_null(spark, sf), require=True)
    flag = lambda df, v: df.select("o_orderkey", F.lit(v).alias("usable"))
    return flag(good, True).unionByName(flag(bad, False))


@query("prj8_variant_product", """WITH a AS (SELECT p_partkey, unnest([lower(p_brand), upper(p_brand)]) AS a, unnest([0, 1]) AS i FROM part),
b AS (SELECT p_partkey, unnest([p_name, p_type, p_brand]) AS b, unnest([0, 1, 2]) AS k FROM part)
SELECT p_partkey, (i * 3 + k)::INT AS variant_no, a || 'j' || b AS variant FROM a JOIN b USING (p_partkey)""")
def _(spark, sf):
    combos = augment.combine_variants(
        F.array(F.lower("p_brand"), F.upper("p_brand")), F.array("p_name", "p_type", "p_brand")
    )
    rows = table(spark, sf, "part").select("p_partkey", F.transform(combos, tk.join_strings).alias("variants"))
    return augment.explode_variants(rows)


@query("prj11_padded_rows", f"""WITH {MOLECULES_SQL}, t AS (SELECT mol_id, list_transform({body('smiles')}, lambda x: ascii(x)) AS i FROM molecules),
w AS (SELECT max(len(i)) AS w FROM t),
p AS (SELECT mol_id, list_concat(i, list_transform(range(w - len(i)), lambda q: 0)) AS ids,
 list_concat(list_transform(i, lambda q: 1), list_transform(range(w - len(i)), lambda q: 0)) AS mask FROM t, w)
SELECT mol_id, {list_text('ids')} AS input_ids, {list_text('mask')} AS attention_mask, {list_text('ids')} AS labels FROM p""")
def _(spark, sf):
    ids = F.transform(tk.body_tokens(F.col("smiles")), lambda t: F.ascii(t))
    rows = selection.training_rows(molecules(spark, sf).select("mol_id", ids.alias("ids")))
    return rows.select("mol_id", *[joined(F.col(c), c) for c in ("input_ids", "attention_mask", "labels")])


_DEPTH = """list_reduce(list_concat([0], list_transform(regexp_extract_all({0}, '[()]'), lambda c: CASE c WHEN '(' THEN 1 ELSE -1 END)),
 lambda d, c: CASE WHEN d < 0 THEN d ELSE d + c END) = 0"""


def checks_sql(c: str) -> str:
    bare = f"regexp_replace({c}, '\\[[^\\[\\]]*\\]', '', 'g')"
    labels = f"regexp_extract_all({bare}, '(%[0-9]{{2}}|[0-9])', 1)"
    return f"""({c} <> '' AND regexp_replace({c}, '{tk.STRICT_TOKEN_PATTERN}', '', 'g') = '') AS covered,
 {_DEPTH.format(c)} AS parens, NOT regexp_matches({bare}, '[\\[\\]]') AS brackets,
 len(list_filter(list_distinct({labels}), lambda q: len(list_filter({labels}, lambda z: z = q)) % 2 = 1)) = 0 AS rings"""


@query("flt1_validity", f"""WITH {MOLECULES_SQL}, c AS (SELECT mol_id, {checks_sql('smiles')} FROM molecules)
SELECT *, covered AND parens AND brackets AND rings AS valid FROM c""")
def _(spark, sf):
    return _validity(molecules(spark, sf), "mol_id", "smiles")


@query("flt1_validity_text", f"""WITH c AS (SELECT doc_id, {checks_sql('text')} FROM documents)
SELECT *, covered AND parens AND brackets AND rings AS valid FROM c""")
def _(spark, sf):
    return _validity(heavy(spark, sf, "documents"), "doc_id", "text")


@query("flt1_validity_pages", f"""WITH c AS (SELECT page_id, {checks_sql('html')} FROM pages)
SELECT *, covered AND parens AND brackets AND rings AS valid FROM c""")
def _(spark, sf):
    return _validity(heavy(spark, sf, "pages"), "page_id", "html")


def _validity(df, key, text):
    c = F.col(text)
    return df.select(
        key, validity.covered(c).alias("covered"), validity.parentheses_balanced(c).alias("parens"),
        validity.brackets_balanced(c).alias("brackets"), validity.rings_paired(c).alias("rings"),
        validity.is_valid(c).alias("valid"),
    )


@query("flt2_ionic", f"""WITH {MOLECULES_SQL} SELECT mol_id, NOT regexp_matches(smiles, '[.+-]') AS all_, NOT regexp_matches(smiles, '[.+]') AS plus,
NOT regexp_matches(smiles, '[.-]') AS minus, true AS none FROM molecules""")
def _(spark, sf):
    keep = lambda mode: validity.is_neutral(F.col("smiles"), mode)
    return molecules(spark, sf).select(
        "mol_id", keep("all").alias("all_"), keep("+").alias("plus"), keep("-").alias("minus"), keep("off").alias("none")
    )


@query("flt6_atom_tokens", f"""WITH {MOLECULES_SQL}, t AS (SELECT mol_id, unnest({body('smiles')}) AS token FROM molecules)
SELECT token, count(*) AS n FROM t WHERE token NOT IN ({STRUCTURAL_SQL}) AND NOT regexp_matches(token, '^[0-9]+$') GROUP BY ALL""")
def _(spark, sf):
    rows = molecules(spark, sf).select(F.explode(tk.body_tokens(F.col("smiles"))).alias("token"))
    return interpret.atom_tokens(rows).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("set4_ordered_dedupe", f"""WITH t AS (SELECT doc_id, {body('text')} AS t FROM documents),
u AS (SELECT doc_id, unnest(t) AS x, unnest(range(len(t))) AS i FROM t),
f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY ALL)
SELECT doc_id, coalesce(string_agg(x, '~' ORDER BY i), '') AS tokens FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id""")
def _(spark, sf):
    return heavy(spark, sf, "documents").select("doc_id", joined(F.array_distinct(tk.body_tokens(F.col("text"))), "tokens"))


@query("set5_vocabulary_union", f"""SELECT DISTINCT unnest({tok('text')}) AS token FROM (SELECT text FROM documents UNION ALL
SELECT text FROM benchmark UNION ALL SELECT text FROM conversations)""")
def _(spark, sf):
    toks = lambda n: heavy(spark, sf, n).select(tk.tokenize(F.col("text")).alias("tokens"))
    return vocabulary.union_tokens(toks("documents"), toks("benchmark"), toks("conversations"))


@query("udf1_variant_provider", """SELECT o_orderkey, (unnest(range(2)))::INT AS variant_no,
unnest([o_orderpriority, lower(o_orderpriority)]) AS variant FROM orders""")
def _(spark, sf):
    provider = augment.variant_provider(lambda s: pd.Series([list(dict.fromkeys(pair)) for pair in zip(s, s.str.lower())], index=s.index))
    rows = table(spark, sf, "orders").select("o_orderkey", provider(F.col("o_orderpriority")).alias("variants"))
    return augment.explode_variants(rows)


@query("prj2_fill_strings", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS smiles FROM orders""")
def _(spark, sf):
    holes = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("smiles")
    )
    return shaping.fill_strings(holes, ["smiles"])
