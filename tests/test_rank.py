"""Positions, running totals and order statistics against brute force, with one
key and one value holding a large share of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from molspark.operators import rank


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows; a third has key 0 and a third has value 7."""
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).alias("k"),
        F.when(F.col("id") % 3 == 1, 7.0).otherwise((F.col("id") * 7919 % 1009).cast("double")).alias("v"),
    )
    return df.repartition(6), [(r["id"], r["k"], r["v"]) for r in df.collect()]


def test_ordinal(skewed):
    df, rows = skewed
    got = {r["id"]: r["ordinal"] for r in rank.ordinal(df, [F.col("v").desc(), F.col("id")]).collect()}
    want = {i: n for n, (i, _, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    assert got == want


def test_keyed_ordinal_and_prefix(skewed):
    df, rows = skewed
    got = rank.prefix(df, [F.col("v"), F.col("id")], {"s": ("sum", "v"), "lo": ("min", "id"), "hi": ("max", "id")}, ["k"]).collect()
    pos = {r["id"]: r["ordinal"] for r in rank.ordinal(df, [F.col("v"), F.col("id")], ["k"]).collect()}
    state, want = {}, {}
    for i, k, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        n, s, lo, hi = state.get(k, (0, 0.0, 10**9, -1))
        assert pos[i] == n
        state[k] = (n + 1, s + v, min(lo, i), max(hi, i))
        want[i] = state[k][1:]
    assert {r["id"]: (r["s"], r["lo"], r["hi"]) for r in got} == want
    assert {(r["k"], r["s_total"]) for r in got} == {(k, s[1]) for k, s in state.items()}


@pytest.mark.parametrize("accuracy", [100, 50_000])
def test_order_statistics(skewed, accuracy):
    """A coarse sketch takes the bracket path, a fine one the full-group path."""
    df, rows = skewed
    probs = {"a": 0.05, "b": 0.5, "c": 0.95, "min": 0.0, "max": 1.0}
    out = rank.order_statistics(df.withColumn("g", F.col("k") % 2), "v", probs, ["g"], accuracy=accuracy).collect()
    assert len(out) == 10
    for r in out:
        values = [v for _, k, v in rows if k % 2 == r["g"]]
        assert r["n"] == len(values)
        assert r["stat"] == pytest.approx(np.quantile(values, probs[r["name"]]))


@pytest.mark.parametrize("k", [0, 1, 700, 1500, 2000, 2999, 3000, 5000])
def test_top_rows_with_ties(skewed, k):
    df, rows = skewed
    got = sorted(r["id"] for r in rank.top_rows(df, "v", "id", k).collect())
    assert got == sorted(i for i, _, _ in sorted(rows, key=lambda r: (-r[2], r[0]))[:k])


def test_order_statistics_without_key(skewed):
    df, rows = skewed
    out = rank.order_statistics(df, "v", {"a": 0.25, "b": 0.5}, [], accuracy=100).collect()
    values = [v for _, _, v in rows]
    assert {r["name"]: r["stat"] for r in out} == {"a": pytest.approx(np.quantile(values, 0.25)), "b": pytest.approx(np.quantile(values, 0.5))}
    plan = rank.order_statistics(df, "v", {"a": 0.25}, [])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
