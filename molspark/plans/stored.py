"""Fitted ensembles as tables: saved, loaded in part, and scored by dot products.

A member is a row with its fold, run, coefficients and the scales of its fold. Members
are stored in partitions of fold and run beside a manifest of one row, so a later job
reads only the members it asks for. Scoring adds up the coefficients of a string's
hashed n-grams, which is the dot product with their counts, inside the row: all members
travel with the tasks in parts of bounded size, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from molspark.operators import ensemble
from molspark.operators.augment import explode_variants, split_rejected
from molspark.plans.cross_validation import Ensemble, extra_array, hashed_grams, row_text
from molspark.staging import stage

MEMBERS = (
    "fold int, run int, kind string, n_features int, intercept double, coefficients array<double>, "
    "center double, scale double, extra_center array<double>, extra_scale array<double>"
)
PART_VALUES = 1 << 21  # coefficients sent to the tasks at once


def member_table(model: Ensemble) -> DataFrame:
    """The members of a fitted ensemble, one row each; a member has some hundred numbers."""
    scales = {} if model.scaler is None else {r["fold"]: (r["center"], r["scale"]) for r in model.scaler.collect()}  # one row per fold
    rows = []
    for (fold, run), fitted in sorted(model.members.items()):
        center, scale = scales.get(fold, (0.0, 1.0))
        extra = model.extra_scales[fold] if model.extra_scales else ()
        rows.append((
            fold, run, model.kind, model.n_features, float(fitted.intercept), [float(x) for x in fitted.coefficients],
            float(center), float(scale), [float(c) for c, _ in extra], [float(s) for _, s in extra],
        ))
    spark = model.spark()
    return spark.createDataFrame(rows, MEMBERS)


def save(members: DataFrame, folder: str) -> None:
    """Writes the members, then a manifest that tells what there is; a folder without one was not finished."""
    members.write.partitionBy("fold", "run").parquet(f"{folder}/members")
    known = members.sparkSession.read.schema(MEMBERS).parquet(f"{folder}/members")
    known.agg(
        F.max("kind").alias("kind"),
        F.max("n_features").alias("n_features"),
        F.count_distinct("fold").alias("n_folds"),
        F.count_distinct("run").alias("n_runs"),
        F.count(F.lit(1)).alias("n_members"),
        F.coalesce(F.bool_or((F.col("center") != 0) | (F.col("scale") != 1)), F.lit(False)).alias("scale_output"),
        F.coalesce(F.bool_or(F.size("extra_center") > 0), F.lit(False)).alias("has_extra"),
        F.array_sort(F.collect_set("fold")).alias("folds"),
        F.array_sort(F.collect_set("run")).alias("runs"),
    ).write.parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> Row:
    return spark.read.parquet(f"{folder}/manifest").first()


@dataclass
class StoredEnsemble:
    """Some members of a saved ensemble."""

    members: DataFrame
    kind: str
    n_features: int
    has_extra: bool
    n_members: int

    def _parts(self) -> list[DataFrame]:
        """The members in one row each of bounded size."""
        size = max(1, PART_VALUES // max(1, self.n_features))
        count = -(-self.n_members // size)
        columns = F.struct("fold", "run", "intercept", "coefficients", "center", "scale", "extra_center", "extra_scale")
        dealt = self.members.withColumn("_part", F.pmod(F.xxhash64("fold", "run"), F.lit(max(1, count))))
        return [dealt.where(F.col("_part") == k).agg(F.array_sort(F.collect_list(columns)).alias("_m")) for k in range(max(1, count))]

    def _prediction(self, m: Column) -> Column:
        total = F.aggregate(F.col("grams"), m["intercept"], lambda s, g: s + F.coalesce(F.get(m["coefficients"], g), F.lit(0.0)))
        if self.has_extra:
            scaled = F.transform(F.col("extras"), lambda x, i: F.coalesce((x - F.get(m["extra_center"], i)) / F.get(m["extra_scale"], i), F.lit(0.0)))
            weights = F.transform(scaled, lambda x, i: x * F.get(m["coefficients"], F.lit(self.n_features) + i))
            total = F.aggregate(weights, total, lambda s, x: s + x)
        if self.kind == "classification":
            return 1.0 / (1.0 + F.exp(-total))
        return total * m["scale"] + m["center"]

    def score(self, rows: DataFrame, own: str | None = None) -> DataFrame:
        """Rows with ``grams`` (and ``extras``) under every member: their columns, fold, run, pred.

        ``own`` names a column with the row's own fold; then only members of that fold
        score it, and the column is replaced by the members' fold.
        """
        if self.has_extra and "extras" not in rows.columns:
            raise ValueError("the ensemble was trained with extra columns, which the input lacks")
        keep = [c for c in rows.columns if c not in ("grams", "extras", own)]
        out = None
        for part in self._parts():
            wide = rows.crossJoin(F.broadcast(part))  # one row
            fitting = F.col("_m") if own is None else F.filter("_m", lambda m: m["fold"] == F.col(own))
            preds = F.transform(fitting, lambda m: F.struct(m["fold"].alias("fold"), m["run"].alias("run"), self._prediction(m).alias("pred")))
            long = wide.select(*keep, F.explode(preds).alias("_e")).select(*keep, "_e.*")
            out = long if out is None else out.unionByName(long)
        return out

    def infer(self, df: DataFrame, text: str | Sequence[str], key: str, variants: Column | None = None, extras: Sequence[str] = ()) -> DataFrame:
        """Input rows with ``mean, sigma``; rows without usable variants keep nulls."""
        rows = df.withColumn("variants", F.array(row_text(text)) if variants is None else variants)
        good, _ = split_rejected(rows)
        keep = [key] if not extras else [key, extra_array(extras)]
        each = explode_variants(good.select(*keep, "variants"))
        graded = each.withColumn("grams", hashed_grams(F.col("variant"), self.n_features)).drop("variant")
        return ensemble.attach(df, ensemble.mean_sigma(self.score(graded), key), key)

    def out_of_fold(self, df: DataFrame, text: str | Sequence[str], key: str, fold: str = "fold", extras: Sequence[str] = ()) -> DataFrame:
        """``key, fold, run, pred`` of every row under the members that were fitted without its fold."""
        more = [] if not extras else [extra_array(extras)]
        rows = df.select(key, fold, *more, hashed_grams(row_text(text), self.n_features).alias("grams"))
        return self.score(rows, own=fold)


def load(spark: SparkSession, folder: str, folds: Sequence[int] | None = None, runs: Sequence[int] | None = None) -> StoredEnsemble:
    """The members of some folds and runs (all by default); other partitions are not read.

    Folds and runs that the manifest does not name are errors.
    """
    known = manifest(spark, folder)
    for name, wanted, held in (("folds", folds, known["folds"]), ("runs", runs, known["runs"])):
        if wanted is not None and not set(wanted) <= set(held):
            raise ValueError(f"{name} {sorted(set(wanted) - set(held))} are not in {folder}, which has {held}")
    members = spark.read.schema(MEMBERS).parquet(f"{folder}/members")
    if folds is not None:
        members = members.where(F.col("fold").isin(list(folds)))
    if runs is not None:
        members = members.where(F.col("run").isin(list(runs)))
    found = stage(members, "members")
    return StoredEnsemble(found, known["kind"], known["n_features"], known["has_extra"], found.count())
