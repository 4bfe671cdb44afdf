"""Sets of hashed token runs made in the tasks are those of the columns."""

import random

import pytest
from pyspark.sql import functions as F

from molspark.functions import hashing
from molspark.functions.tokens import ngrams, tokenize


def texts():
    rnd = random.Random(6)
    parts = ["C", "c", "n", "Cl", "Br", "B", "l", "r", "[NH3+]", "[é\U0001f600]", "[", "]", "%12", "%1", "|.", ".", "\\", "|", "\n", "(", ")", "=", "é", " ", "7", "\U0001f600", "[a\nb]", "x"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(80))) for _ in range(300)]
    return out + [None, "", "C", "CCCCCC", "CCCCCCC", "C" * 500, "[" + "N" * 90 + "]" + "Cl" * 12, "the quick brown fox jumps over the lazy dog " * 20]


@pytest.mark.parametrize("length", [2, 8])
def test_sets_equal_those_of_the_columns(spark, monkeypatch, length):
    monkeypatch.setattr(hashing, "_REMEMBERED", 50)
    df = spark.createDataFrame(list(enumerate(texts())), "id long, t string")
    found = df.select("id", hashing.gram_set(F.col("t"), length).alias("a"), hashing.fragment_set(ngrams(tokenize(F.col("t")), length)).alias("b"))
    rows = found.collect()
    assert len(rows) == len(texts()) and all(list(r.a) == list(r.b) for r in rows)
    assert spark.createDataFrame([], "t string").select(hashing.gram_set(F.col("t"), length)).collect() == []
