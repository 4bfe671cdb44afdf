"""Fold and split properties."""

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from molspark.operators import splits


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 40)), min_size=1, max_size=6, unique_by=lambda t: t[0]), st.integers(1, 6))
def test_fill_lightest_equals_one_by_one(sizes, k):
    loads, naive = [0] * k, [0] * k
    for size, count in sorted(sizes, reverse=True):
        given_ = splits.fill_lightest(loads, size, count)
        assert sum(given_) == count
        loads = [x + g * size for x, g in zip(loads, given_)]
        for _ in range(count):
            naive[naive.index(min(naive))] += size
        assert loads == naive


def digest(seed, key):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


@pytest.mark.parametrize("digits", [1, 4])
def test_quota_labels_follow_the_hash_order(spark, digits):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    quotas = [0, 10, 10, 200, 5000]
    out = splits.quota_labels(
        df, "id", 9, lambda s: s.withColumn("cuts", F.array(*[F.lit(q).cast("bigint") for q in quotas])),
        strata=["g"], bucket_digits=digits,
    ).collect()
    assert len(out) == 1000
    for g in range(3):
        order = sorted((i for i in range(1000) if i % 3 == g), key=lambda i: digest(9, i))
        want = {i: sum(q <= n for q in quotas) for n, i in enumerate(order)}
        assert {r["id"]: r["label"] for r in out if r["g"] == g} == want


def test_group_kfold_keeps_groups_whole_under_skew(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 97).alias("g"))
    rows = splits.group_kfold(df, "g", 4).collect()
    assert len(rows) == 3000
    folds = {}
    for r in rows:
        folds.setdefault(r["g"], set()).add(r["fold"])
    assert all(len(f) == 1 for f in folds.values())
    sizes, naive = Counter(r["g"] for r in rows), [0] * 4
    for size in sorted(sizes.values(), reverse=True):
        naive[naive.index(min(naive))] += size
    assert [Counter(r["fold"] for r in rows)[i] for i in range(4)] == naive


def test_stratified_fold_sizes(spark):
    df = spark.range(101).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    rows = splits.stratified_kfold(df, "id", "y", 3).collect()
    by_fold = Counter(r["fold"] for r in rows)
    assert max(by_fold.values()) - min(by_fold.values()) <= 1
    ones = Counter(r["fold"] for r in rows if r["y"] == 1)
    assert max(ones.values()) - min(ones.values()) <= 1


def test_split_sizes_and_repeatability(spark):
    df = spark.range(9)
    first = splits.train_valid(df, "id").collect()
    assert Counter(r["split"] for r in first) == {"train": 6, "valid": 3}
    again = splits.train_valid(df.repartition(5), "id").collect()
    assert sorted(first) == sorted(again)


def test_labeling_does_not_shuffle_the_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(10_000).withColumn("payload", F.lit("x" * 50)).write.parquet(path)
    out = splits.train_valid(spark.read.parquet(path), "id")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "BroadcastHashJoin" in final
    wide = [line for line in final.splitlines() if "Exchange hash" in line or "Exchange range" in line]
    assert wide and all("payload" not in line for line in wide)


def test_resample_keeps_repeats(spark):
    out = splits.resample(spark.range(10), ["id"], 200).collect()
    assert len(out) == 200 and len({r["draw"] for r in out}) == 200 and {r["id"] for r in out} == set(range(10))
