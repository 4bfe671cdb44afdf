import random
import re

import pytest
from pyspark.sql import functions as F

from molspark.llm import url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "block"), ("a.org", "", "block")]
LISTED = ["bad.example.com", "worse.com"]


def urls():
    rnd = random.Random(5)
    hosts = ["net", "x.net", "EXAMPLE.net", "m.example.net", "example.com", "www.example.com", "bad.example.com", "m.bad.example.com", "notbad.example.com", "worse.com", "a.org", "b.a.org", "", "x..net", "é.com"]
    paths = ["", "/", "/en/1", "/de/", "/de", "/fr/x", "/en", "?q=/en/", "#/fr/", "/de/?x", "/e\nn/"]
    out = [(i, rnd.choice(("http", "HTTPS", "")) + "://" + rnd.choice(hosts) + rnd.choice(paths)) for i in range(250)]
    return out + [(1000, None), (1001, ""), (1002, "example.net/en/"), (1003, "http://x.net/a://b/"), (None, "http://x.net/"), (3, out[3][1]), (1004, "http://" + "a." * 200 + "net/" + "x" * 20_000)]


def verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
    path = re.match("[^?#]*", rest[len(host):])[0] if rest else ""
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        rule = max(f[:3] for f in fits)[2]
        return host, path, rule, "block" if any(f[2] == rule and f[3] == "block" for f in fits) else "allow"
    return host, path, None, "block" if any(host == k or host.endswith("." + k) for k in LISTED) else "allow"


def judged(spark, data):
    pages = spark.createDataFrame(data, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS path", "3 AS rule", "4 AS suffixes", "5 AS id")
    return url_filter.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), spark.createDataFrame([(k,) for k in LISTED], "key string"))


@pytest.mark.parametrize("bits", [1 << 25, 0])  # 0: the form by join
def test_verdicts(spark, monkeypatch, bits):
    monkeypatch.setattr(url_filter, "MAX_BITS", bits)
    found = judged(spark, urls())
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((i, *verdict(u)) for i, u in urls()), key=repr)


@pytest.mark.parametrize("listed, others", [(0, 50), (1, 0), (300, 20), (20, 5000), (1000, 1000)])
def test_cascade_is_exact_on_its_universe(spark, listed, others):
    inside, outside = [f"in{i}" for i in range(listed)], [f"out{i}" for i in range(others)]
    frame = lambda keys: spark.createDataFrame([(k,) for k in [*keys, *keys[:3], None]], "key string")
    levels = url_filter.build_cascade(frame(inside), frame(inside[: listed // 2] + outside))
    found = frame(inside + outside).where("key IS NOT NULL").select("key", url_filter.contains(levels, F.col("key")).alias("yes")).collect()
    assert all(r.yes == r.key.startswith("in") for r in found)
    assert sum(level.words * 64 for level in levels) <= 64 * len(levels) + 12 * listed + 4 * max(listed, 1) * (others > listed)


def test_empty(spark):
    assert judged(spark, urls()).limit(0).count() == 0 and judged(spark, [(1, "x")]).limit(1).count() == 1
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, spark.createDataFrame([], "host string, path string, verdict string"), spark.createDataFrame([], "key string")).collect() == []
    allowed = url_filter.judge(spark.createDataFrame([(1, "http://x.net/")], none.schema), spark.createDataFrame([], "host string, path string, verdict string"), spark.createDataFrame([], "key string"))
    assert allowed.first().verdict == "allow"


def test_no_python(spark):
    assert not re.search("Python|Arrow|Pandas", judged(spark, urls())._jdf.queryExecution().toString())
