"""Seeded splits and folds.

All of them are quotas over the md5 order of the row key inside a stratum. A count
per leading digits of the digest locates each quota border in one bucket; only the
keys of those buckets are sorted, to read off the digest at the border. Labeling is
then a comparison with a few digests per stratum: the large table is neither
shuffled nor sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from molspark.functions.hashing import leading_bits, seeded_digest, uniform
from molspark.operators.rank import ordinal
from molspark.operators.shaping import match_keys
from molspark.staging import stage

BUCKET_DIGITS = 4
BROADCAST_ROWS = 100_000


def quota_labels(
    df: DataFrame,
    key: str | Sequence[str],
    seed,
    cuts: Callable[[DataFrame], DataFrame],
    strata: Sequence[str] = (),
    n_strata: int | None = None,
    label: str = "label",
    bucket_digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Label rows by where their hash rank falls between cumulative quotas.

    ``cuts`` receives one row per stratum with its size ``n`` and adds an array
    ``cuts`` of cumulative row counts; the label is how many cuts a rank has
    reached. ``key`` must identify a row. The border table has one row per
    stratum and is broadcast while there are few strata, joined by shuffle beyond.
    The keys are read a few times, so pass a stored table rather than a costly plan.
    """
    keys = [key] if isinstance(key, str) else list(key)
    strata = list(strata)
    digest = seeded_digest(seed, *[F.col(k) for k in keys])
    if not strata:
        # one stratum as a real column (digests are 32 long), so that joins stay hash joins
        df, strata, n_strata = df.withColumn("_all", F.length(digest)), ["_all"], 1
    if n_strata is None:
        n_strata = df.select(*strata).distinct().count()

    def small(t):
        return F.broadcast(t) if n_strata <= BROADCAST_ROWS else t

    order = df.select(*strata, digest.alias("_h")).withColumn("_b", leading_bits(F.col("_h"), bucket_digits))
    buckets = order.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    sized = cuts(buckets.groupBy(*strata).agg(F.sum("_c").alias("n")))
    targets = (
        match_keys(
            buckets.withColumn("_end", F.sum("_c").over(run)),
            small(sized.select(*strata, F.posexplode("cuts").alias("_i", "_cut"))), strata,
        )
        .where("_cut >= _end - _c AND _cut < _end")
        .select(*strata, "_b", "_i", (F.col("_cut") - F.col("_end") + F.col("_c") + 1).alias("_nth"))
    )
    inside = Window.partitionBy(*strata, "_b", "_i").orderBy("_h")
    borders = (
        match_keys(order, small(targets), [*strata, "_b"])
        .withColumn("_rn", F.row_number().over(inside))
        .where("_rn = _nth")
        .groupBy(*strata)
        .agg(F.collect_list("_h").alias("_borders"))  # one per cut
    )
    reached = F.when(F.col("_borders").isNull(), 0).otherwise(
        F.size(F.filter("_borders", lambda c: c <= F.col("_h")))
    )
    labeled = match_keys(df.withColumn("_h", digest), small(borders), strata, "left").withColumn(label, reached)
    return labeled.drop("_h", "_borders", "_all")


def _cumulative(counts: list[Column]) -> Column:
    """Cut points from quota columns, the last quota being the rest."""
    cuts, total = [], F.lit(0).cast("bigint")
    for c in counts[:-1]:
        total = total + c.cast("bigint")
        cuts.append(total)
    return F.array(*cuts) if cuts else F.array().cast("array<bigint>")


def shuffled_kfold(df: DataFrame, key: str, k: int, seed: int = 123) -> DataFrame:
    """Plain shuffled folds; the first ``n % k`` folds get one more row."""
    def cuts(s):
        n = F.col("n")
        return s.withColumn(
            "cuts", _cumulative([F.floor(n / k) + (F.lit(i) < n % k).cast("int") for i in range(k)])
        )
    return quota_labels(df, key, seed, cuts, label="fold")


def stratified_kfold(df: DataFrame, key: str, target: str, k: int, seed: int = 42) -> DataFrame:
    """Shuffled folds that keep class shares: with classes laid out in ascending
    order, a class fills fold i as often as it covers positions equal to i mod k."""
    def cuts(s):
        before = Window.orderBy(target).rowsBetween(Window.unboundedPreceding, -1)  # one row per class
        s = s.withColumn("_s", F.coalesce(F.sum("n").over(before), F.lit(0)))
        upto = lambda p, i: F.floor((p + (k - 1 - i)) / k)
        counts = [upto(F.col("_s") + F.col("n"), i) - upto(F.col("_s"), i) for i in range(k)]
        return s.withColumn("cuts", _cumulative(counts))
    return quota_labels(df, key, seed, cuts, strata=[target], label="fold")


def fill_lightest(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` equal groups each fold gets when every group goes to
    the lightest fold, the first one on ties.

    The groups take the ``count`` lowest levels among load, load + size, ...; the
    highest level reached is found by bisection.
    """
    def places(level):
        return [max(0, -((load - level) // size)) for load in loads]

    low, high = min(loads), min(loads) + size * count + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(places(mid)) <= count else (low, mid)
    given = places(low)
    left = count - sum(given)
    for i, load in enumerate(loads):
        if left and load <= low and (low - load) % size == 0:
            given[i] += 1
            left -= 1
    return given


def group_kfold(df: DataFrame, group: str, k: int, seed: int = 42) -> DataFrame:
    """Whole groups to folds, balanced by rows.

    Only the histogram of group sizes reaches the driver (distinct sizes grow
    with the square root of the rows at most). Groups of one size are
    interchangeable; hash order decides which of them go where.
    """
    groups = stage(df.groupBy(group).agg(F.count(F.lit(1)).alias("_size")), "groups")
    histogram = groups.groupBy("_size").agg(F.count(F.lit(1)).alias("n"))
    sizes = [(r["_size"], r["n"]) for r in histogram.orderBy(F.desc("_size")).collect()]
    loads, rows = [0] * k, []
    for size, count in sizes:
        given = fill_lightest(loads, size, count)
        loads = [load + g * size for load, g in zip(loads, given)]
        rows.append((size, list(accumulate(given[:-1]))))
    planned = df.sparkSession.createDataFrame(rows, "_size bigint, cuts array<bigint>")
    folds = quota_labels(
        groups, group, seed, lambda s: s.join(planned, "_size"), strata=["_size"],
        n_strata=len(sizes), label="fold",
    )
    return match_keys(df, folds.select(group, "fold"), [group])


def train_share(n: Column, share: str) -> Column:
    """Rows that train: ceil of six ninths, or floor of eight tenths."""
    return {"ceil_6_9": F.ceil(n * 6 / 9), "floor_0_8": F.floor(n * 0.8)}[share]


def train_valid(df: DataFrame, key: str, seed: int = 42, share: str = "ceil_6_9", strata: Sequence[str] = (), n_strata: int | None = None) -> DataFrame:
    """Split column ``train``/``valid`` over all rows, or inside each stratum."""
    def cuts(s):
        return s.withColumn("cuts", F.array(train_share(F.col("n"), share).cast("bigint")))
    out = quota_labels(df, key, seed, cuts, strata=strata, n_strata=n_strata, label="_split")
    return out.withColumn("split", F.when(F.col("_split") == 0, "train").otherwise("valid")).drop("_split")


def cross_validation_splits(df: DataFrame, key: str, k: int, seed: int = 42, keep_test: bool = True) -> DataFrame:
    """For every model fold: its own rows test, the others split train/valid.

    Input has ``fold``; output has one row per (row, model fold).
    """
    each = df.withColumnRenamed("fold", "_own").withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    )
    rest = train_valid(each.where("fold <> _own"), key, seed, strata=["fold"], n_strata=k).drop("_own")
    if not keep_test:
        return rest
    test = each.where("fold = _own").drop("_own").withColumn("split", F.lit("test"))
    return rest.unionByName(test)


def split_shares(df: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Fractions of train, valid and test rows."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        *[(F.count_if(F.col("split") == s) / n).alias(f"{s}_share") for s in ("train", "valid", "test")]
    )


def select_members(df: DataFrame, folds: Sequence[int] | None = None, runs: Sequence[int] | None = None) -> DataFrame:
    """Fold and run subset; prunes partitions when the table is stored by them."""
    if folds is not None:
        df = df.where(F.col("fold").isin(list(folds)))
    if runs is not None:
        df = df.where(F.col("run").isin(list(runs)))
    return df


def group_numbers(df: DataFrame, column: str, name: str = "group_no") -> DataFrame:
    """Dense number of equal values in ascending order, from 0; nulls come first."""
    numbered = ordinal(df.select(column).distinct(), [F.col(column)], name=name)
    return match_keys(df, numbered, [column])


def minibatches(df: DataFrame, order: Sequence[Column], batch_size: int) -> DataFrame:
    """Batch number by global position."""
    return ordinal(df, order, name="row_no").withColumn("batch", F.floor(F.col("row_no") / batch_size))


def batch_count(n: Column, batch_size: int) -> Column:
    return F.ceil(n / batch_size)


def resample(df: DataFrame, key: Sequence[str], size: int, seed: int = 21) -> DataFrame:
    """``size`` draws with replacement; repeats stay as separate rows.

    Only the key columns, which must identify a row, are put in order; the rest of
    a row joins the drawn keys. ``row_no`` is the row's position by the keys.
    """
    positions = ordinal(df.select(*key), [F.col(c) for c in key], name="row_no")
    n = positions.agg(F.max("row_no")).first()[0]
    draws = df.sparkSession.range(size).select(
        F.col("id").alias("draw"),
        F.floor(uniform(seed, F.col("id")) * (0 if n is None else n + 1)).alias("row_no"),
    )
    drawn = draws.join(positions, "row_no")
    return match_keys(df, F.broadcast(drawn) if size <= BROADCAST_ROWS else drawn, list(key))
