"""Intake until a target, over restarts, and state that ends."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from molspark.operators import selection
from molspark.staging import fresh_path
from molspark.streaming import intake, target

SCHEMA = "smiles string, ts timestamp"


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)


def feed(spark, folder):
    return lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, files=1000):
    return intake.candidate_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=files)


def test_counts_over_restarts_equal_one_pass(spark):
    folder, out = fresh_path(spark, "arrivals"), fresh_path(spark, "target")
    put, everything = feed(spark, folder), []
    for k in range(4):
        rows = [(s, at(k)) for s in ("CCO", "CCO", "C(", "CC.O", None, "", "C" * (k + 1), "N" * (k + 1), "O" * (k // 2 + 1))]
        everything += rows
        put(rows)
        assert target.run_until(stream(spark, folder), out, 100) is False
    whole = selection.acceptance(spark.createDataFrame(everything, SCHEMA), 100).first()
    assert target.acceptance(spark, out, 100).first() == whole
    assert target.accepted(spark, out).count() == whole.accepted == target.accepted(spark, out).select("smiles").distinct().count()


def test_stops_at_the_target_and_goes_on_from_there(spark):
    folder, out = fresh_path(spark, "arrivals"), fresh_path(spark, "target")
    put = feed(spark, folder)
    for k in range(5):
        put([("C" * (3 * k + i + 1), at(k)) for i in range(3)])
    assert target.run_until(stream(spark, folder, 1), out, 4) is True
    assert target.counts(spark, out).agg(F.sum("attempts")).first()[0] == 6  # two files, the third is left
    assert target.run_until(stream(spark, folder, 1), out, 4) is True
    assert target.counts(spark, out).count() == 2
    assert target.run_until(stream(spark, folder, 1), out, 100) is False
    assert tuple(target.acceptance(spark, out, 100).first()) == (15, 15, 15, 0, 15, 85)


def test_a_repeated_batch_replaces_itself(spark):
    out = fresh_path(spark, "target")
    rows = spark.createDataFrame([("CCO", at(0)), ("CCN", at(0))], SCHEMA)
    for number in (0, 1, 1, 0):
        target.take_batch(rows, number, out)
    assert sorted((r.batch, r.unique) for r in target.counts(spark, out).collect()) == [(0, 2), (1, 0)]


def test_strings_are_new_again_after_the_limit(spark):
    out = fresh_path(spark, "target")
    for number, minute in enumerate((0, 20, 50, 200)):
        target.take_batch(spark.createDataFrame([("CCO", at(minute))], SCHEMA), number, out, time="ts", limit="30 MINUTES")
    assert [r.unique for r in target.counts(spark, out).orderBy("batch").collect()] == [1, 0, 1, 1]  # the second copy does not renew the first


def test_empty_intake(spark):
    folder, out = fresh_path(spark, "arrivals"), fresh_path(spark, "target")
    feed(spark, folder)([])
    assert target.run_until(stream(spark, folder), out, 5) is False
    assert tuple(target.acceptance(spark, out, 5).first()) == (0, 0, 0, 0, 0, 5)


def test_state_of_the_stream_is_bounded(spark):
    folder, out, state = fresh_path(spark, "arrivals"), fresh_path(spark, "out"), fresh_path(spark, "state")
    put, sizes = feed(spark, folder), []
    for hour in range(6):
        put([("C" * (10 * hour + i + 1), at(60 * hour + i)) for i in range(10)] + [("CCO", at(60 * hour)), ("C(", at(60 * hour))])
        query = (
            target.accepted_within(stream(spark, folder), "ts", "30 minutes").writeStream.format("parquet")
            .option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        sizes.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert max(sizes) <= 25
    found = [r.smiles for r in spark.read.parquet(out).collect()]
    assert 2 <= found.count("CCO") <= 6  # the watermark follows a batch behind
    assert len(found) - found.count("CCO") == len(set(found) - {"CCO"}) == 6 * 10
