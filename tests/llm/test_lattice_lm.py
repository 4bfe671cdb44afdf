import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from molspark.llm import lattice_lm
from tests.llm.helpers import SCHEMA, lowered, rows, table, words_of

VOCABULARY = {"▁": -1.0, "▁a": -2.0, "a": -1.5, "b": -2.5, "ab": -3.0, "▁ab": -4.0, "ba": -2.2, "</s>": -1.0} | {f"<0x{b:02X}>": -9.0 for b in range(256)}
def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2



def segmentations(text, logs):
    """All segmentations as lists of pieces; a character without a piece takes its bytes."""
    if not text:
        yield []
        return
    for k in range(1, len(text) + 1):
        if text[:k] in logs:
            for rest in segmentations(text[k:], logs):
                yield [text[:k], *rest]
    if text[0] not in logs:
        for rest in segmentations(text[1:], logs):
            yield [f"<0x{b:02X}>" for b in text[0].encode()] + rest


@pytest.mark.parametrize("word", ["", "a", "ab", "abab", "bbaab", "xab", "aéb", "\U0001F600a"])
def test_forward_and_expected_counts(word):
    lattice = lattice_lm.Lattice(VOCABULARY)
    paths = list(segmentations("▁" + word, VOCABULARY))
    weights = [math.exp(sum(VOCABULARY[p] for p in path)) for path in paths]
    assert lattice.forward([word])[0] == pytest.approx(math.log(sum(weights)), abs=1e-9)
    wanted = collections.Counter()
    for path, w in zip(paths, weights):
        for p in path:
            wanted[p] += 3 * w / sum(weights)
    counts = np.zeros(len(VOCABULARY))
    lattice.expect([word], np.array([3.0]), counts)
    assert dict(zip(lattice.pieces, counts)) == pytest.approx({p: wanted[p] for p in VOCABULARY}, abs=1e-9)


def test_words_of_many_lengths_at_once():
    lattice = lattice_lm.Lattice(VOCABULARY)
    words = ["ab" * k + "x" * (k % 3) for k in range(60)] + ["a" * 30_000]
    assert lattice.forward(words).tolist() == pytest.approx([lattice.forward([w])[0] for w in words])


def expected_base(data):
    tokens = [words_of(lowered(t)) + [None] for _, t, *_ in data]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in data]
    counts = collections.Counter(w for t, h in zip(tokens, held) if not h for w in t)
    total, distinct = sum(counts.values()), len(counts)
    score = lambda c: math.log10((c + 1) / (total + distinct + 1))
    return [(i, h, len(t), sum(counts[w] > 0 for w in t), total, sum(score(counts[w]) for w in t)) for (i, *_), h, t in zip(data, held, tokens)]


def compare(found, wanted):
    found, wanted = (sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[5])) for x in (found, wanted))
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    assert [r[5] for r in found] == pytest.approx([r[5] for r in wanted], rel=1e-9)


@pytest.mark.parametrize("frequent", [0, 20, 200_000])
def test_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(lattice_lm, "FREQUENT_WORDS", frequent)
    found = lattice_lm.score(table(spark), held_out()).collect()
    compare([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found], expected_base(rows()))
    totals = sorted(r.score for r in found)
    assert all(s < 0 for s in totals)
    monkeypatch.setattr(lattice_lm, "FREQUENT_WORDS", 7)
    assert sorted(r.score for r in lattice_lm.score(table(spark), held_out()).collect()) == pytest.approx(totals)


def test_score_is_the_sum_over_words(spark):
    data = [(1, "ab ba ab", "en", "a", 1), (3, "ab", "en", "a", 1), (4, "ba", "en", "a", 1), (5, "", "en", "a", 1)]
    found = {r.doc_id: r.score for r in lattice_lm.score(spark.createDataFrame(data, SCHEMA), F.lit(False)).collect()}
    assert found[1] == pytest.approx(2 * found[3] + found[4] - 2 * found[5])


def test_training_raises_the_likelihood(spark):
    """The step never lowers the likelihood of what it is fitted to."""
    words = spark.createDataFrame([("abab", 5, 5), ("ba", 9, 9), ("xx", 2, 2)], "word string, c long, seen long")
    fitted = lattice_lm.fit(words, 4, VOCABULARY)
    total = lambda logs: (lattice_lm.Lattice(logs).forward(["abab", "ba", "xx"]) * [5, 9, 2]).sum() + 4 * logs["</s>"]
    assert total(fitted) > total(lattice_lm._normalised(VOCABULARY))
    assert math.fsum(math.exp(v) for v in fitted.values()) == pytest.approx(1.0)


def test_nothing_to_learn_from(spark):
    found = lattice_lm.score(spark.createDataFrame([(1, "a b", "en", "a", 1)], SCHEMA), F.lit(True)).first()
    assert (found.train_tokens, found.n_known, found.base_score) == (0, 0, 0.0) and found.score < 0


def test_empty(spark):
    assert lattice_lm.score(spark.createDataFrame([], SCHEMA), held_out()).collect() == []
