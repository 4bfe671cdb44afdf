import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from molspark.llm import quality_model
from tests.llm.helpers import FOLDER, SCHEMA, prose, rows, table

def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1



def labelled(n):
    rnd = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        text = prose(rnd, rnd.randrange(40, 200))
        if not good:
            text = text.upper() if i % 2 else " ".join(w + "#" for w in text.split())
        docs.append((i, text, "en", "a", 1))
        labels.append((i, int(good), 0))
    return docs, labels


def labels_table(spark, data):
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


def walk(trees, x):
    """Scores by following each tree node by node."""
    out = []
    for row in x:
        total = trees.base
        for feature, limit, value in zip(trees.feature, trees.limit, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > limit[node])
            total += value[node - len(feature)]
        out.append(1 / (1 + np.exp(-total)))
    return out


def test_held_out_rows_are_told_apart(spark):
    docs, labels = labelled(900)
    found = quality_model.classify(spark.createDataFrame(docs, SCHEMA), labels_table(spark, labels), held_out()).where("held_out").collect()
    truth = {i: q for i, q, _ in labels}
    assert len(found) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in found]) > 0.98


def test_held_out_labels_have_no_effect(spark):
    docs, labels = labelled(300)
    frame = spark.createDataFrame(docs, SCHEMA)
    found = [sorted(map(tuple, quality_model.classify(frame, labels_table(spark, data), held_out()).collect())) for data in (
        labels, [(i, 1 - q if spark_held(i) else q, 1) for i, q, _ in labels])]
    assert found[0] == found[1]


def spark_held(i):
    import zlib
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_flat_traversal_equals_walking():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, len(quality_model.STATISTICS)))
    y = (x[:, 0] + x[:, 3] * x[:, 5] > 0).astype(float)
    trees = quality_model.fit(x, y)
    assert trees.score(x).tolist() == pytest.approx(walk(trees, x))
    assert np.mean((trees.score(x) >= 0.5) == y) > 0.9


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(2)
    x = np.zeros((200, len(quality_model.STATISTICS)))
    x[:, 7] = rng.permutation(200)
    trees = quality_model.fit(x, (x[:, 7] > 120).astype(float))
    assert trees.feature[0, 0] == 7 and abs(trees.limit[0, 0] - 120) < 5


def test_awkward_rows(spark):
    docs = table(spark)
    labels = labels_table(spark, [(i, i % 2, 0) for i in range(40)] + [(3, 0, 0), (3, 1, 0), (None, 1, 0), (5, None, 0), (6, 7, 0)])
    found = quality_model.classify(docs, labels, held_out()).collect()
    assert len(found) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    scores = {}
    for (i, t, *_), r in zip(sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0)), sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0))):
        if i is not None:
            assert scores.setdefault(t or "", r.score) == r.score


def test_without_labels_or_rows(spark):
    none = labels_table(spark, [])
    assert {r.score for r in quality_model.classify(table(spark), none, held_out()).collect()} == {0.5}
    assert quality_model.classify(spark.createDataFrame([], SCHEMA), none, held_out()).collect() == []


def test_on_the_driver_tables(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_model.classify(docs, labels, held_out()).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in found]) >= 0.8
