"""Verdicts beside a plain reading of the rules, and the cascade's exactness."""

import random

import numpy as np

from lucarne.llm.url_filter import Level, _u64, build_cascade, judge, listed
from lucarne.session import small_table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), ("b.org", "/fr/x", "block"), ("dup.com", "/", "allow"), ("dup.com", "/", "block"), ("dup.com", "/", "block")]
URLS = [
    None, "", "no scheme", "http://", "http://NET/", "http://net", "http://a.net?x", "http://x.example.net/en/1", "http://example.net/en", "http://xexample.net/en/",
    "https://b.org/fr/xyz", "https://a.b.org/fr/x", "https://a.b.org/fr/?q", "https://a.b.org/fr/#x", "http://É.net/é", "http://dup.com/1", "http://a..net/", "http://.net/", "a://b://c.net/",
    "http://net/\n/x", "http://" + "a." * 300 + "org/fr/" + "y" * 5000, "http://net/", "http://net/",
]


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fits, default=(0, 0, None, "allow"))
    return host, path, rule, verdict


def test_odd_urls(spark):
    df = spark.createDataFrame([(i, u, "mine", 1, 2) for i, u in enumerate(URLS)], "page_id int, url string, host string, keys int, found int")
    rules = small_table(spark, [*RULES, (None, "/", "block")], "host string, path string, verdict string")
    got = judge(df, rules)
    assert got.columns == ["page_id", "url", "keys", "found", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, RULES), r.url
        assert (r["keys"], r["found"]) == (1, 2)
    assert judge(df.limit(0), rules).count() == 0
    assert {(r.rule, r.verdict) for r in judge(df, rules.limit(0)).collect()} == {(None, "allow")}


def test_long_hosts_and_paths(spark):
    """Hosts of many labels and paths of many characters take no more memory than their own text."""
    urls = ["http://" + "a." * 20_000 + "net/x", "http://" + "b." * 20_000 + "org/fr/" + "y" * 1_000_000, "http://" + "." * 20_000 + "/", "http://x." + "example.net" + "/en/" + "é" * 50_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    for r in judge(df, small_table(spark, RULES, "host string, path string, verdict string")).collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, RULES)


def test_many_path_lengths(spark):
    """A rule of each of 1500 path lengths; the longest that fits decides."""
    rules = [("x.net", "/" + "a" * n, "block" if n % 2 else "allow") for n in range(1500)]
    urls = [f"http://w.x.net/{'a' * n}b" for n in (0, 1, 700, 1499, 1600)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    for r in judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, rules)


def test_cascade_is_exact(spark):
    """A coarse first level makes many false positives; the later levels take them all out."""
    pick = random.Random(3)
    pairs = [(pick.getrandbits(63), pick.getrandbits(63)) for _ in range(20000)]
    universe = spark.createDataFrame(pairs, "a long, b long")
    keys = spark.createDataFrame(pairs[:3000], "a long, b long")
    levels = build_cascade(universe, keys, share=0.3)
    assert len(levels) > 2
    a, b = (_u64([p[i] for p in pairs]) for i in (0, 1))
    assert np.array_equal(np.flatnonzero(listed(levels, a, b)), np.arange(3000))
    assert len(build_cascade(universe, keys.limit(0))) == 1


def test_no_keys():
    level = Level.sized(0, 0, 0.01)
    assert not listed([level], _u64([1, 2]), _u64([3, 4])).any()
