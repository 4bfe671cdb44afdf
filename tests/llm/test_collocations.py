from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from molspark.llm import collocations
from tests.llm.helpers import SCHEMA, lowered, plain, rows, table


def brute(data, least, top=2000, longest=5):
    """Counts of all stretches of words in plain Python, then the scores by the definition."""
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, found in counts.items():
        good = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in good.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], a)
        scored = []
        for p, a in good.items():
            if p in inside and 100 * inside[p] >= 100 * a:
                continue
            n = totals[lang]
            score, _, left, right = min((1000 * a * n // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right, n))
        for rank, (score, a, phrase, left, right, n) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out, key=repr)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def texts(seed=4):
    rnd = random.Random(seed)
    words = ["New", "York", "the", "a", "of", "é", "中文", "x", "\x1c", "re-do", "U.S.", "#"]
    made = [rnd.choice((" ", "  ", "\t", ", ", ". ", "\n")).join(rnd.choice(words) for _ in range(rnd.randrange(0, 60))) for _ in range(200)]
    made += ["to be or not to be. " * 30, "so so so so " * 40, "x" * 5000, "new york city hall is new york city hall " * 20]
    return [(i, t, rnd.choice(("en", "en", "fr", None, "und")), "a", 1) for i, t in enumerate(made)] + rows()


@pytest.mark.parametrize("least", [3, 20, 100])
def test_operator_against_brute_force(spark, least):
    data = texts()
    got = collocations.collocations(table(spark, data), min_count=least)
    assert plain(got, *COLUMNS) == brute(data, least)


def test_joined_ids_and_small_chunks_give_the_same(spark, monkeypatch):
    data = texts(9)
    expected = brute(data, 10)
    monkeypatch.setattr(collocations, "SENT_ROWS", 0)
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 300)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 500)
    assert plain(collocations.collocations(table(spark, data), min_count=10), *COLUMNS) == expected


def test_shorter_phrases_and_first_rows(spark):
    data = texts(5)
    for longest, top in ((2, 3), (3, None)):
        got = collocations.collocations(table(spark, data), max_words=longest, min_count=8, top=top)
        assert plain(got, *COLUMNS) == brute(data, 8, top or 10**9, longest)


def test_tiles_against_plain_counts(monkeypatch):
    rnd = np.random.default_rng(1)
    for tile, thin in ((1024, 16), (4, 16), (4, 1)):
        monkeypatch.setattr(collocations, "TILE", tile)
        monkeypatch.setattr(collocations, "THIN", thin)
        codes = np.minimum(rnd.zipf(1.3, 20_000), 30_000).astype(np.int32) - 1
        codes[rnd.random(20_000) < 0.2] = 0
        keys, counts = collocations.pair_counts(codes)
        expected = Counter((int(a), int(b)) for a, b in zip(codes, codes[1:]) if a and b)
        assert len(keys) == len(expected)
        assert {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(c) for k, c in zip(keys, counts)} == expected


def test_recoded_drops_only_repeated_zeros():
    keys = np.array([1 << 32 | 2, 2 << 32 | 1])
    codes = np.array([3, 3, 3, 1, 2, 1, 0, 1, 2], np.int32)
    assert collocations.recoded(codes, keys, np.array([7, 8])).tolist() == [0, 7, 8, 0, 7]
    assert collocations.recoded(codes[:1], keys, np.array([7, 8])).tolist() == []


def test_scores_beyond_64_bits(spark):
    wide = spark.sql("SELECT CAST(1000 AS DECIMAL(4,0)) * CAST(900000000000000000 AS DECIMAL(18,0)) AS up, CAST(900000000000000000 AS DECIMAL(18,0)) AS n")
    exact = wide.selectExpr("(CAST(up AS DECIMAL(21,0)) * CAST(7 AS DECIMAL(18,0))) DIV (n * CAST(3 AS DECIMAL(18,0))) AS q").first().q
    assert exact == 2333


def test_empty_table_and_no_frequent_phrase(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(table(spark, [(1, "a b c", "en", None, None), (2, None, None, None, None)])).collect() == []


def test_cells_pass_over_rare_phrases_only(spark, monkeypatch):
    """With cells from the first place on the rows stay the same, and few rare phrases are counted."""
    data = texts(11)
    expected = brute(data, 20)
    monkeypatch.setattr(collocations, "CELL_PLACES", 0)
    monkeypatch.setattr(collocations, "CELL_BITS", (17, 26))
    monkeypatch.setattr(collocations, "PHRASE_WORDS", 500)
    assert plain(collocations.collocations(table(spark, data), min_count=20), *COLUMNS) == expected
    monkeypatch.setattr(collocations, "CELL_BITS", (1, 1))  # cells so few that none can be passed over
    assert plain(collocations.collocations(table(spark, data), min_count=20), *COLUMNS) == expected


def test_a_task_emits_frequent_phrases_alone():
    rnd = np.random.default_rng(2)
    codes = rnd.integers(1, 1000, 200_000).astype(np.int32)  # nearly every pair is rare
    codes[::20], codes[1::20] = 7, 8
    keys, counts = collocations.pair_counts(codes)
    sums = np.bincount(collocations._cell(keys, 20), counts, 1 << 20)
    marked = np.packbits(sums >= 100, bitorder="little")
    rows = [dict(zip(b.column("key").to_pylist(), b.column("n").to_pylist())) for b in collocations._counted_phrases([(0, "en", codes)], {"en": (20, marked)})]
    wanted = dict(zip(keys[counts >= 100].tolist(), counts[counts >= 100].tolist()))
    found = {k: n for r in rows for k, n in r.items()}
    assert wanted and {k: found[k] for k in wanted} == wanted
    assert len(found) < len(wanted) + len(keys) / 100
