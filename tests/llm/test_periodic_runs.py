from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from molspark.llm import periodic_runs, queries
from tests.llm.helpers import FOLDER, SCHEMA, rows, table, words_of


def brute(words, least=12):
    """Start, length, period of all runs, by comparing the words with themselves for every shift."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def rest(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sample(rnd, kind, n):
    if kind == "few words":
        return [rnd.randrange(2) for _ in range(n)]
    if kind == "one period":
        part = [rnd.randrange(3) for _ in range(rnd.randrange(1, 70))]
        words = (part * (n // len(part) + 1))[:n]
        for _ in range(rnd.randrange(3) if n else 0):
            words[rnd.randrange(n)] = rnd.randrange(3)
        return words
    if kind == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    words = []
    while len(words) < n:
        words += [rnd.randrange(2) for _ in range(rnd.randrange(1, 40))] * rnd.randrange(1, 6)
    return words[:n]


@pytest.mark.parametrize("kind", ["few words", "one period", "fibonacci", "powers"])
def test_runs_against_brute_force(kind):
    rnd = random.Random(kind)
    for _ in range(300):
        words = sample(rnd, kind, rnd.randrange(0, 400))
        got = [(int(s), int(e - s), int(q)) for s, e, q in periodic_runs.runs(np.array([*words, -1]))]
        assert got == brute(words), words


def test_successor_against_brute_force():
    rnd = np.random.default_rng(2)
    for size in (1, 2, 50, 300):
        values = rnd.permutation(size)
        tree = periodic_runs.WaveletMatrix(values, size)
        low = rnd.integers(0, size, 500)
        high, least = np.minimum(size, low + rnd.integers(0, size + 1, 500)), rnd.integers(0, size + 3, 500)
        expected = [min((v for v in values[a:b] if v >= x), default=size) for a, b, x in zip(low, high, least)]
        assert tree.successor(low, high, least).tolist() == expected


def test_progressions_keep_work_small():
    part = np.r_[np.zeros(99, np.int64), 1]
    for words, period in ((np.zeros(200_000, np.int64), 1), (np.tile(np.arange(37), 5000), 37), (np.tile(part, 2000), 100)):
        began = time.time()
        found = periodic_runs.runs(np.r_[words, -1])
        assert [0, len(words), period] in found.tolist()
        assert time.time() - began < 20


def test_operator_against_brute_force(spark):
    repeated = "a b c d e f g " * 40
    data = rows() + [(5000, repeated + " x " + repeated, "en", "a", 5), (5001, repeated + " x " + repeated, "en", "a", 5), (5002, "so " * 5000, None, None, None)]
    got = periodic_runs.find_runs(table(spark, data)).collect()
    expected = []
    for r in data:
        words = words_of(r[1])
        found = brute(words) if len(words) < 5100 else []  # the longest text has no short words in a row
        expected.append((r[0], len(words), found, rest(words, found)))
    plain = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got]
    assert sorted(plain, key=repr) == sorted(expected, key=repr)


def test_texts_of_a_batch_do_not_mix(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_BATCH_BYTES", 50)
    text = b"a b c d " * 6
    assert [(s.start, s.stop) for s in periodic_runs._groups([text, b"x", b"y", text])] == [(0, 3), (3, 4)]
    counts, found, left = periodic_runs._searched([text, text, b"", text], 12)
    assert counts == [24, 24, 0, 24] and [f.tolist() for f in found] == [[[0, 24, 4]], [[0, 24, 4]], [], [[0, 24, 4]]]
    assert left == [b"a b c d", b"a b c d", b"", b"a b c d"]


def test_empty_table(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_brute_force(spark):
    got = {r.doc_id: r.asDict() for r in queries.QUERIES["op12_periodic_runs"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    some = 0
    for r in docs:
        words, h = words_of(r.text), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute(words) if n < 3000 else None
        if found is None:
            continue
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[r.doc_id] == {
            "doc_id": r.doc_id, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": None if best[0] is None else 1000 * best[1] // best[2],
            "runs_sha256": sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), "collapsed_sha256": sha(rest(words, found)),
        }
        some += len(found) > 0
    assert some > 10
