"""The sampler against a plain walk, and its join form with a frequent token."""

from __future__ import annotations

import bisect
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from molspark.functions.hashing import leading_md5
from molspark.functions.tokens import SENTINEL
from molspark.operators import generate


def plain_walk(shares, seed, cand_id, max_length):
    steps = defaultdict(list)
    for cur, nxt, _, hi in sorted(shares):
        steps[cur].append((hi, nxt))
    cur, out = SENTINEL, []
    for step in range(max_length):
        u = int(hashlib.md5(f"{seed}|{cand_id}|{step}".encode()).hexdigest()[:8], 16) / 4294967296.0
        cur = steps[cur][bisect.bisect_right([h for h, _ in steps[cur]], u)][1]
        if cur == SENTINEL:
            break
        out.append(cur)
    return "".join(out)


def fan(n, seed=0):
    """One start token with ``n`` successors, each of which goes on in one of two ways."""
    rnd = random.Random(seed)
    rows = [(SENTINEL, f"<{i}>", rnd.randrange(1, 50)) for i in range(n)]
    for i in range(n):
        rows += [(f"<{i}>", SENTINEL, 1), (f"<{i}>", f"<{(i * 7 + 1) % n}>", rnd.randrange(1, 4))]
    return rows


def test_vectorised_digests():
    rnd = random.Random(1)
    for suffix in (b"", b"7", b"123456"):
        prefixes = ["".join(rnd.choice("0123456789|") for _ in range(rnd.randrange(1, 30))) for _ in range(500)]
        expected = [int(hashlib.md5(p.encode() + suffix).hexdigest()[:8], 16) for p in prefixes]
        assert leading_md5(np.array(prefixes, dtype=bytes), suffix).tolist() == expected
    with pytest.raises(ValueError):
        leading_md5(np.array(["x" * 50], dtype=bytes), b"123456")


@pytest.mark.parametrize("n", [1, 3, 1000])
def test_both_forms_walk_like_a_plain_one(spark, n):
    counts = spark.createDataFrame(fan(n), "cur string, next string, n long")
    shares = generate.cumulative_shares(counts)
    rows = [tuple(r) for r in shares.collect()]
    ids = spark.range(400).withColumnRenamed("id", "cand_id")
    expected = {i: plain_walk(rows, 9, i, 15) for i in range(400)}
    for limit in (generate.TABLE_LIMIT, 0):
        got = generate.sample(ids, shares, 9, max_length=15, limit=limit)
        assert {r.cand_id: r.smiles for r in got.collect()} == expected


def test_slots_hold_every_draw_once(spark):
    counts = spark.createDataFrame(fan(100), "cur string, next string, n long")
    lookup = generate.range_lookup(generate.cumulative_shares(counts)).where(F.col("cur") == SENTINEL).collect()
    assert {r.slot for r in lookup} == set(range(128)) and len(lookup) <= 128 + 100
    for u in np.random.default_rng(0).integers(0, 1 << 32, 500) / 2.0**32:
        assert sum(r.slot == int(u * 128) and r.lo <= u < r.hi for r in lookup) == 1


def test_no_candidates_and_no_transitions(spark):
    shares = generate.cumulative_shares(spark.createDataFrame(fan(3), "cur string, next string, n long"))
    none = spark.range(0).withColumnRenamed("id", "cand_id")
    assert generate.sample(none, shares, 1).collect() == [] and generate.sample(none, shares, 1, limit=0).collect() == []
    ids = spark.range(2).withColumnRenamed("id", "cand_id")
    assert [r.smiles for r in generate.sample(ids, shares.limit(0), 1).collect()] == ["", ""]
