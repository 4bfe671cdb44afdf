"""Golden cases and edge strings of the token functions."""

import pytest
from pyspark.sql import functions as F

from molspark.functions import scores, tokens as tk, validity
from molspark.operators import augment, vocabulary


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "s string").select(*cols).first()


@pytest.mark.parametrize("text, expected", [
    ("CC=O", ["C", "C", "=", "O"]),
    (r"C[C@H](N)/C=C\C(=O)O.Cl", ["C", "[C@H]", "(", "N", ")", "/", "C", "=", "C", "C", "(", "=", "O", ")", "O", "Cl"]),
    ("c1ccc%12Br[nH]", ["c", "1", "c", "c", "c", "%12", "Br", "[nH]"]),
    ("C|.N B", ["C", "|.", "N", "B"]),
    ("[a\nb]c", ["b", "c"]),
    ("", []),
])
def test_tokenizer(spark, text, expected):
    assert one(spark, text, tk.tokenize(F.col("s")))[0] == [" ", *expected, " "]


def test_strict_keeps_backslash_and_dot(spark):
    assert one(spark, r"C\C.N", tk.body_tokens(F.col("s"), True))[0] == ["C", "\\", "C", ".", "N"]


@pytest.mark.parametrize("n, expected", [
    (1, [" ", "C", "C", "=", "O", " "]), (2, [" C", "CC", "C=", "=O", "O "]), (3, [" CC", "CC=", "C=O", "=O "]), (7, []),
])
def test_ngrams(spark, n, expected):
    assert one(spark, "CC=O", tk.ngrams(tk.tokenize(F.col("s")), n))[0] == expected


@pytest.mark.parametrize("by", [1, 5])
def test_rotate(spark, by):
    items = F.array(*[F.lit(i) for i in range(4)])
    assert one(spark, "", tk.rotate(items, by))[0] == [1, 2, 3, 0]


def test_join_and_forms(spark):
    row = one(
        spark, "CC", tk.join_strings(F.array(F.lit("CC"), F.lit(""), F.lit("O"))),
        tk.two_forms(F.col("s"), F.lit(None).cast("string")), tk.all_rotations(F.array(F.lit("a"), F.lit("b"), F.lit("a"))),
    )
    assert row[0] == "CCjO" and row[1] == ["CC"] and row[2] == ["aba", "baa", "aab"]


def test_fit_width(spark):
    ids = lambda n: F.array(*[F.lit(i + 2) for i in range(n)])
    row = one(spark, "", tk.fit_width(ids(2), 4), tk.fit_width(ids(6), 4), tk.fit_width(ids(4), 4))
    assert list(row) == [[0, 0, 2, 3], [4, 5, 6, 7], [2, 3, 4, 5]]


@pytest.mark.parametrize("text, ok", [
    ("CCO", True), ("C(C", False), ("C)C(", False), ("C1CC", False), ("C1CC1", True), ("C%12CC%12", True), ("C%12CC1", False),
    ("[NH3+]C", True), ("[NH3+C", False), ("C.N", True), (" CCO ", True), ("", False), ("CXC", False), (None, False), ("C[1]C", True),
])
def test_validity(spark, text, ok):
    assert one(spark, text, validity.is_valid(F.col("s")))[0] is ok


@pytest.mark.parametrize("mode, kept", [
    ("all", ["CCO"]), ("+", ["c1cc(-c2)c1", "CCO"]), ("-", ["C[NH3+]", "CCO"]), ("off", ["C[NH3+]", "CC.O", "c1cc(-c2)c1", "CCO"]),
])
def test_ionic(spark, mode, kept):
    df = spark.createDataFrame([("C[NH3+]",), ("CC.O",), ("c1cc(-c2)c1",), ("CCO",)], "s string")
    assert [r[0] for r in df.where(validity.is_neutral(F.col("s"), mode)).collect()] == kept


def test_encode_decode_round_trip(spark):
    df = spark.createDataFrame([(1, "CC(=O)N"), (2, "c1ccccc1"), (3, "")], "id int, s string").withColumn("tokens", tk.tokenize(F.col("s")))
    vocab = vocabulary.build_vocabulary(df)
    entries = vocabulary.vocabulary_list(vocab)
    assert entries[:2] == ["pad", "unk"] and entries[2:] == sorted(entries[2:])
    a = vocabulary.encode(df, vocab, 12, "id").select("id", "s", "ids").collect()
    b = vocabulary.encode_by_join(df, vocab, 12, "id").select("id", "s", "ids").collect()
    assert sorted(a) == sorted(b) and all(len(r["ids"]) == 12 for r in a)
    back = vocabulary.encode(df, vocab, 12, "id").select("s", tk.decode(F.col("ids"), entries).alias("d")).collect()
    assert all(r["s"] == r["d"] for r in back)


def test_reject_all_is_an_error(spark):
    df = spark.createDataFrame([(1, [None])], "id int, variants array<string>")
    with pytest.raises(ValueError):
        augment.split_rejected(df, require=True)


@pytest.mark.parametrize("value, expected", [(0.0, "0.3"), (123.0, "1.1"), (5000.0, "1.0"), (0.02, "0.5"), (1.0, "0.3"), (2.0, "1.3")])
def test_display_precision(spark, value, expected):
    assert one(spark, "", scores.display_precision(F.lit(value), 4))[0] == expected


def test_score_clamps(spark):
    raw = [F.lit(x) for x in (3.0, -20.0, -2.9, -2.7)]
    easy, hard, above_eight, middle = one(spark, "", *[scores.rescale_score(r) for r in raw])
    assert easy == 1.0 and 8.0 < hard <= 10.0
    assert above_eight < 8.2 and middle == pytest.approx(11 - (-2.7 + 5) / 6.5 * 9)


def test_error_bars_need_a_known_form():
    with pytest.raises(ValueError):
        scores.error_bars(F.lit(1), [F.lit(1)] * 3, "other")
