import re

import numpy as np
import pytest

from reelmill.llm import urls

RULES = {"net/": ("net", "/", "block"), "example.net/en/": ("example.net", "/en/", "allow"), "example.com/de/": ("example.com", "/de/", "block"), "org/fr/": ("org", "/fr/", "allow")}
BAD = {"ads-track", "cheap-pills", "free-bets", "spam-farm"}
URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/1", "http://example.net/en", "http://example.net/EN/", "https://notexample.net/en/2", "http://x.net?q=/", "http://x.net",
    "http://www.spam-farm.example.org/fr/9", "http://www.spam-farm.example.org/frx", "ftp://free-bets#/x", "http://a.example.com/de/1?x#y", "http://example.com/de#", "x://y://z/en/", "http://u:p@h.org:80/fr/?",
    "http://ads-track.x/path with space/?q", "http://É.org/fr/ü", "http://" + "a" * 5000 + ".net/" + "b" * 5000,
]


def slow(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = re.match(r"[^/?#]*", rest).end()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut])
        path = re.match(r"[^?#]*", rest[cut:]).group()
    fits = [r for r, (h, p, _) in RULES.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=len, default=None)
    return host, path, rule, RULES[rule][2] if rule else "block" if BAD & set(host.split(".")) else "allow"


@pytest.mark.parametrize("params", [urls.Params(), urls.Params(bits=1, hashes=1), urls.Params(max_filter_bytes=8)])
def test_pages(spark, small, params):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url")
    more = spark.createDataFrame([(1000 + i, u) for i, u in enumerate(URLS)] + [(1, "http://free-bets/")] * 2, "page_id long, url string")
    pages = pages.unionByName(more)
    want = sorted(((r["page_id"], *slow(r["url"])) for r in pages.collect()), key=str)
    assert sorted(map(tuple, urls.judge(pages.selectExpr("*", "1 as host", "2 as listed"), params).collect()), key=str) == want


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


@pytest.mark.parametrize(("n", "listed"), [(0, 0), (50, 0), (50, 50), (4000, 700), (4000, 3990)])
def test_cascade_is_exact(spark, n, listed):
    rng = np.random.default_rng(n + listed)
    keys = rng.integers(-(2**63), 2**63 - 1, size=(n, 2))
    table = spark.createDataFrame([(int(a), int(b), i < listed) for i, (a, b) in enumerate(keys)], "h1 long, h2 long, listed boolean")
    cascade = urls.build(table, urls.Params(bits=4, hashes=3))
    got = cascade.contains(keys[:, 0].copy().view(np.uint64), keys[:, 1].copy().view(np.uint64))
    assert got.tolist() == [i < listed for i in range(n)]
    assert listed != 700 or len(cascade.levels) > 2


@pytest.mark.parametrize("params", [urls.Params(), urls.Params(max_filter_bytes=256)])
def test_hosts_come_from_a_table(spark, params):
    pages = spark.createDataFrame([(i, f"http://h{i % 700}.example/") for i in range(1500)] + [(9000, None), (9001, "http://h1.example.x")], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.example",) for i in range(0, 900, 3)] + [(None,), ("h3.example",), ("nowhere",)], "host string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, params, listed).collect()}
    assert got == {**{i: "block" if i % 700 % 3 == 0 else "allow" for i in range(1500)}, 9000: "allow", 9001: "allow"}


def test_no_page_is_joined(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    for params in (urls.Params(), urls.Params(max_filter_bytes=64)):
        assert "Join" not in urls.judge(pages, params)._jdf.queryExecution().toString()
