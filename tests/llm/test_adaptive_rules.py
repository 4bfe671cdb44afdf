import collections
import math
import random

from molspark.llm import adaptive_rules
from tests.llm.helpers import SCHEMA, prose, rows, table, words_of


def expected(text):
    text = text or ""
    words = words_of(text)
    grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_counts(spark):
    rnd = random.Random(4)
    data = rows() + [(2000 + i, "\n".join(rnd.choice(("a b c", "a b  c", "", "## x", "d e f g h i j k l m")) for _ in range(30)), "en", "a", 1) for i in range(40)]
    found = adaptive_rules.judge(table(spark, data))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(((d[0], *expected(d[1])) for d in data), key=repr)
    assert found.where("base_failed AND kept").count() == 0 and found.where("kept IS NULL").count() == 0


def junk_and_clean(n):
    rnd = random.Random(6)
    out = []
    for i in range(n):
        lang, source = ("en", "fr")[i % 2], ("hot" if i % 3 else f"s{i % 7}")
        text = prose(rnd, rnd.randrange(60, 400))
        if i % 10 == 0:
            text = " ".join(w + "###" for w in text.split())
        out.append((i, text, lang, source, 1))
    return out


def test_outliers_go_and_others_stay(spark):
    data = junk_and_clean(600)
    found = {r.doc_id: r for r in adaptive_rules.judge(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(not found[i].kept and "symbols" in found[i].broken for i in range(0, 600, 10))
    clean = [found[i].kept for i in range(600) if i % 10]
    assert sum(clean) > 0.99 * len(clean)


def bounds(spark, data):
    measured = adaptive_rules.per_text(spark.createDataFrame(data, SCHEMA), "text", ["doc_id", "lang", "source"], adaptive_rules._measure, {n: "bigint" for n in adaptive_rules._STATISTICS})
    return {(r._1, r._2): r for r in adaptive_rules.thresholds(measured, ["_1", "_2"]).collect()}


def test_thresholds_blend_exact_quartiles(spark):
    """On groups below the sketch's size its quantiles are exact; language and corpus are one here."""
    groups = {"a": range(100, 250), "b": range(300, 310)}
    data = [(i, " ".join(["word"] * 20 + [str(j) for j in range(i)]), "en", s, 1) for s, some in groups.items() for i in some]
    quartiles = lambda v: [math.log(v[len(v) // 4] + 1), math.log(v[3 * len(v) // 4] + 1)]
    whole = quartiles(sorted(len(t.split()) for _, t, *_ in data))
    for source, some in groups.items():
        own, n = quartiles([20 + i for i in some]), len(some)
        low, high = ((a * n + b * 200) / (n + 200) for a, b in zip(own, whole))
        assert abs(bounds(spark, data)["en", source].few_words - (low - max(1.0, 3 * (high - low)))) < 0.05


def test_no_verdict_turns_at_one_row(spark):
    rnd = random.Random(2)
    prose_rows = [(i, prose(rnd, 100), "en", "hot", 1) for i in range(400)]
    limits = []
    for n in range(195, 206):
        data = prose_rows + [(1000 + i, " ".join(f"x{k} = {k} #" for k in range(rnd.randrange(20, 60))) + prose(rnd, 30), "en", "code", 1) for i in range(n)]
        limits.append(bounds(spark, data)["en", "code"].symbols)
    steps = [abs(a - b) for a, b in zip(limits, limits[1:])]
    assert max(steps) < 0.02


def test_keep_good_agrees_with_judge(spark):
    docs = table(spark, rows() + junk_and_clean(300))
    kept = adaptive_rules.keep_good(docs)
    assert kept.columns == docs.columns
    judged = adaptive_rules.judge(docs).where("kept")
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in judged.collect()), key=repr)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert adaptive_rules.judge(none).collect() == [] and adaptive_rules.keep_good(none).collect() == []
