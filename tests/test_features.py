"""Counts of hashed grams against the expression that also SQL can make, and the way they are made."""

from collections import Counter

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from molspark.plans import cross_validation as cv


def test_counts_are_those_of_the_expression(spark, monkeypatch):
    monkeypatch.setattr(cv, "GRAMS_KEPT", 3)
    texts = ["CCO", "", None, "[Na+]Cl%12CC%12", "no tokens: xyz \u00e9\U0001f600", "C" * 5000, "[a\nb]ClBrCl", "c1ccccc1|.|", "[\u00fc]N"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    made = {r.id: r.a for r in cv.featurise(df, "s", 32).select("id", vector_to_array("features").alias("a")).collect()}
    expected = {r.id: Counter(r.g) for r in df.select("id", cv.hashed_grams(F.col("s"), 32).alias("g")).collect()}
    assert {i: Counter({k: n for k, n in enumerate(a) if n}) for i, a in made.items()} == expected


def test_no_digest_per_occurrence(spark):
    plan = cv.featurise(spark.createDataFrame([("CCO",)], "s string"), "s", 32)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan
