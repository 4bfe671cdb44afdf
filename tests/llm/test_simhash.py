import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from molspark.llm import simhash
from molspark.llm.graph import components
from tests.llm.helpers import SCHEMA, lowered, rows, table, words_of


def expected_fingerprint(text):
    words = words_of(lowered(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected_components(ids, fps):
    """Smallest id reachable, by comparing all pairs of distinct fingerprints."""
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for f in fps]


def test_code_is_perfect():
    words = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    near = simhash.code_indices(words)
    assert set(np.unique((near >= 0).sum(axis=1))) <= {1, 6}
    for bit in range(23):  # the nearest code word of a neighbour is among the nearby ones
        other = simhash.code_indices(words ^ (1 << bit))[:, 0]
        assert (near == other[:, None]).any(axis=1).all()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), min_size=1, max_size=3))
def test_close_fingerprints_share_a_key(fp, bits):
    other = fp
    for b in bits:
        other ^= 1 << b
    pair = np.array([fp, other], dtype=np.uint64).view(np.int64)
    own, near = (set(simhash._keys(pair[i : i + 1], n)[0].tolist()) for i, n in ((0, False), (1, True)))
    assert own & near


def test_near_duplicates(spark):
    data = rows()
    found = simhash.near_duplicates(table(spark, data)).collect()
    fps = [expected_fingerprint(t) for _, t, *_ in data]
    wanted = sorted(zip([r[0] for r in data], [format(f, "016x") for f in fps], expected_components([r[0] for r in data], fps)), key=repr)
    assert sorted(map(tuple, found), key=repr) == wanted


def test_links_within_chains(spark):
    rnd = random.Random(5)
    fps, at = set(), rnd.getrandbits(64)
    for _ in range(150):  # chains of close fingerprints, and dense groups
        at = at ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) if rnd.random() < 0.8 else rnd.getrandbits(64)
        fps |= {at, *(at ^ (1 << rnd.randrange(64)) for _ in range(3))}
    signed = np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist()
    found = {tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    wanted = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert found == wanted


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, 600 + i) for i in range(50)] + [(700, 700), (None, 3), (601, 500)]
    found = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {(i, 0) for i in range(101)} | {(n, 500) for n in [500, *range(600, 650)]}


def test_keep_one(spark):
    data = rows()
    kept = simhash.keep_one(table(spark, data))
    ids = [r[0] for r in data]
    classes = expected_components(ids, [expected_fingerprint(t) for _, t, *_ in data])
    wanted = sorted({i for i, c in zip(ids, classes) if i is not None and i == c}) + [None, None]
    assert kept.columns == table(spark, data).columns
    assert [r.doc_id for r in sorted(kept.collect(), key=lambda r: (r.doc_id is None, r.doc_id))] == wanted


@pytest.mark.parametrize("operator", [simhash.near_duplicates, simhash.keep_one])
def test_empty(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []
