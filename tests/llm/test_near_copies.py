import random

import numpy as np
import pytest

import corpus_pipeline
from molspark.llm import near_copies, simhash
from molspark.staging import stage
from tests.llm.helpers import FOLDER, SCHEMA, lowered, prose, rows, table, words_of


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def shingles(text):
    words = words_of(lowered(text))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def expected_components(data):
    """Per row the smallest id reachable, by comparing all pairs of texts."""
    texts = [tuple(words_of(lowered(t))) for _, t, *_ in data]
    distinct = list(dict.fromkeys(texts))
    sets, parent = {t: shingles(" ".join(t)) for t in distinct}, {t: t for t in distinct}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if jaccard(sets[a], sets[b]) >= 0.8:
                parent[find(a)] = find(b)
    least = {}
    for (i, *_), t in zip(data, texts):
        if i is not None:
            least[find(t)] = min(i, least.get(find(t), i))
    return [least.get(find(t)) for t in texts]


def edited(rnd, text, edits):
    words = text.split()
    for k in rnd.sample(range(len(words)), edits):
        words[k] = "edited"
    return " ".join(words)


def corpus():
    rnd, data = random.Random(6), rows(n=20)
    for k, (n, edits) in enumerate([(100, 1), (100, 2), (200, 3), (300, 5), (1000, 15), (100, 4), (60, 2)] * 6):
        text = prose(rnd, n)
        data += [(2000 + 10 * k, text, "en", "a", 1), (2001 + 10 * k, edited(rnd, text, edits), "en", "a", 1)]
    base = prose(rnd, 150)  # a large group of which many pairs are below the threshold
    return data + [(9000 + k, edited(rnd, base, rnd.randrange(8)), "en", "a", 1) for k in range(150)]


def test_stage_keeps_one_of_each_group(spark):
    """The stage of the pipeline against brute force; all that it should keep and nothing else."""
    data = corpus()
    docs = table(spark, data)
    kept = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    wanted = sorted({i for (i, *_), c in zip(data, expected_components(data)) if i is not None and i == c}) + [None, None]
    assert [r.doc_id for r in sorted(kept.collect(), key=lambda r: (r.doc_id is None, r.doc_id))] == wanted


@pytest.mark.parametrize("cells", [1 << 22, 1 << 10])
def test_forest_joins_what_all_pairs_join(monkeypatch, cells):
    monkeypatch.setattr(near_copies, "_CELLS", cells)
    data = [r for r in corpus() if r[0] and r[0] >= 9000]
    sets = [near_copies.shingles(lowered(t).encode().split()) for _, t, *_ in data]
    ids = np.array([i for i, *_ in data])
    links = near_copies.forest(ids, sets, 0.8)
    parent = {i: i for i in ids.tolist()}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        assert find(a) != find(b)
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in ids.tolist()] == expected_components(data)


def test_bands_find_pairs_at_the_threshold():
    rnd = np.random.default_rng(0)
    missed = 0
    for _ in range(2000):
        pool = rnd.integers(0, 1 << 64, 110, dtype=np.uint64)
        a, b = np.unique(pool[:99]), np.unique(pool[11:])  # 88 of 110 shared: 0.8
        missed += not (near_copies.band_keys(a) == near_copies.band_keys(b)).any()
    assert missed <= 2


def test_one_id_with_two_texts(spark):
    data = [(1, "a b c d e f g", "en", "a", 1), (1, "totally different words here for this one", "en", "a", 1), (1, "a b c d e f g", "en", "a", 1), (2, "A b c  d e f g", "en", "a", 1)]
    kept = near_copies.keep_one(table(spark, data)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "a b c d e f g"), (1, "totally different words here for this one")]


def test_empty(spark):
    assert near_copies.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def random_sets(rnd, pairs, size=99, shared=88):
    """Pairs of sets of equal size; 88 of 110 shared is a similarity of 0.8."""
    pools = (rnd.integers(0, 1 << 64, 2 * size - shared, dtype=np.uint64) for _ in range(pairs))
    return zip(*((np.unique(p[:size]), np.unique(p[size - shared :])) for p in pools))


def test_keys_are_the_likeliest_golay_code_words():
    """Against all 4,096 code words: a key is a pair of code words, nearly always the likeliest ones of its segments."""
    rest = np.zeros(1 << 23, np.int64)
    for bit in range(23):
        rest ^= np.where(np.arange(1 << 23) >> bit & 1, simhash._SINGLE[bit], 0)
    words = np.flatnonzero(rest == 0)
    assert len(words) == 4096
    signs = (words[:, None] >> np.arange(23) & 1) * 2.0 - 1
    sets = [np.random.default_rng(k).integers(0, 1 << 64, n, dtype=np.uint64) for k, n in enumerate((1, 5, 40, 400, 3000))]
    hits = total = 0
    for own, keys in zip(sets, near_copies.sketches(sets)[0]):
        sums = near_copies.bit_sums(own)[: near_copies._BITS] + near_copies._BIAS
        codes = (signs @ sums.reshape(-1, 23).T).argmax(axis=0)
        found = np.stack([keys >> 12 & 4095, keys & 4095], axis=1).ravel()
        hits, total = hits + (words[codes] >> 11 == found).sum(), total + len(found)
        assert (keys >> 24 == np.arange(near_copies.BANDS)).all()
    assert hits >= 0.95 * total


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 2500])
def test_bit_sums(n):
    own = np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64)
    ones = np.zeros(64 * len(near_copies._FACTORS), np.int64)
    for x in own.tolist():
        mixed = np.uint64(x) * near_copies._FACTORS
        mixed = (mixed ^ mixed >> near_copies._SHIFT) * near_copies._MIX
        ones += np.unpackbits((mixed ^ mixed >> near_copies._SHIFT).view(np.uint8), bitorder="little")
    assert (near_copies.bit_sums(own) == 2 * ones - n).all()


@pytest.mark.parametrize("size, shared", [(99, 88), (9, 8), (900, 800), (5000, 4445)])
def test_pairs_at_the_threshold_share_a_key_and_have_close_fingerprints(size, shared):
    left, right = random_sets(np.random.default_rng(3), 500, size, shared)
    (keys, fps), (others, far) = near_copies.sketches(left), near_copies.sketches(right)
    assert ((keys == others).any(axis=1)).sum() >= 499
    assert (np.bitwise_count((fps ^ far).view(np.uint64)) <= near_copies.NEAR).all(axis=1).sum() >= 499
    unlike = np.roll(others, 1, axis=0)
    assert (keys == unlike).sum() <= 5


def test_close_groups():
    rnd = random.Random(2)
    fps = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        fps |= {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(14))) for _ in range(20)}
    fps = np.array(sorted(fps), np.uint64).view(np.int64)
    parent = {f: f for f in fps.tolist()}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in parent:
        for b in parent:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 12:
                parent[find(a)] = find(b)
    wanted = {}
    for f in parent:
        wanted.setdefault(find(f), []).append(f)
    assert sorted(g.tolist() for g in near_copies.close_groups(fps, 12)) == sorted(sorted(g) for g in wanted.values() if len(g) > 1)
    assert near_copies.close_groups(fps[:1]) == near_copies.close_groups(fps[:0]) == []


@pytest.mark.parametrize("rows", [10_000, 3])
def test_buckets_are_those_of_each_key(spark, rows):
    """Keys that go on over several batches are one; far fingerprints and lone ones are in no bucket."""
    data = [(1, 0), (1, 1), (1, 3), (1, 7), (1, -1), (2, 5), (3, 0), (3, 1), (3, 1), (4, 9), (4, 9), (5, 0), (5, 1), (5, 3), (5, 7)]
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        found = near_copies._buckets(spark.createDataFrame(data, "key int, fp long").coalesce(1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    assert sorted(r.fps for r in found) == [[0, 1], [0, 1, 3, 7]]


def test_texts_of_a_group_meet_by_blocks_or_buckets(spark):
    """Any two texts of a group meet under some key; in a group too large, any two of a bucket."""
    rnd = random.Random(4)
    family = [rnd.getrandbits(60) for _ in range(30)]
    buckets = [family[k : k + 3] for k in range(28)] + [[1, 2], [3, 4], [5, 6]]
    fps = [(k, fp, 0) for k, fp in enumerate(family)] + [(100, 1, 0), (101, 2, 0), (102, 3, 0), (103, 4, -1), (104, 5, 0), (105, 5, 0), (106, 6, -1), (107, 7, 0), (108, 7, 0), (109, 8, 0)]
    texts = stage(spark.createDataFrame([(n, f, s) for n, f, s in fps], "node long, fp long, second long"), "texts")
    made = stage(spark.createDataFrame([(b,) for b in buckets], "fps array<long>"), "buckets")
    small = {frozenset(p) for p in [(100, 101), (104, 105), (104, 106), (105, 106), (107, 108)]}
    whole = small | {frozenset((a, b)) for a in range(30) for b in range(a)}
    by_bucket = small | {frozenset((a, b)) for a in range(30) for b in range(max(0, a - 2), a)}
    for half, blocks, wanted in ((500, 32, whole), (4, 32, whole), (4, 3, by_bucket)):
        groups = {}
        for r in near_copies._members(made, texts, half, blocks).collect():
            groups.setdefault(r.key, set()).add(r.node)
        assert {frozenset((a, b)) for g in groups.values() for a in g for b in g if a != b} == wanted


def test_large_groups_are_compared_bucket_by_bucket(spark, monkeypatch):
    data = [(9000 + k, t, "en", "a", 1) for k, (_, t, *_) in enumerate(corpus()[-150:])]
    docs = table(spark, data)
    wanted = sorted({i for (i, *_), c in zip(data, expected_components(data)) if i == c})
    for half, blocks in ((500, 32), (20, 32), (2, 2)):
        monkeypatch.setattr(near_copies._members, "__defaults__", (half, blocks))
        assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == wanted
