"""The url filter against brute force over all rules."""

import random

import pytest
from pyspark.sql import functions as F

from quire.llm import url_filter
from quire.llm.url_filter import ALLOW, BLOCK, UrlTrie, judge_urls, rule_table
from quire.session import ship_package


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):].split("?")[0].split("#")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute(rules, host, path):
    fits = [((len(h.split(".")) if h else 0, len(p), v == BLOCK), v, h + p) for v, h, p in rules
            if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (ALLOW, None)


RULES = [(ALLOW, "org", "/"), (ALLOW, "com", "/fr/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (BLOCK, "com", "/de/")]
URLS = ["http://a.example.org/en/12", "http://example.org/en/2", "http://example.org/es", "http://example.org/es/", "HTTP://EXAMPLE.ORG/es/x?q#f",
        "http://example.org", "http://example.org?x=/es/", "http://x.com/fr/1", "http://x.com/de/", "http://x.com/De/", "http://com/de/1",
        "http://notexample.org/en/1", "http://example.org:80/en/1", "//example.org/es/", None, "", "no scheme", "a://b://c/de/", "://", "http://É.org/ÀB",
        "http://example.org//es/", "http://org/", "http://.org/", "http://example.org./es/", "http://x.com/" + "s/" * 50_000]


def test_against_brute_force(spark):
    ship_package(spark)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (3, URLS[3])], "page_id long, url string")
    pages = pages.withColumns({c: F.lit("x") for c in ("id", "host", "path", "rule", "verdict", "block", "host_labels")})
    rules = rule_table(spark, [r[1:] for r in RULES if r[0] == ALLOW], [r[1:] for r in RULES if r[0] == BLOCK])
    got = judge_urls(pages, rules).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r.id is not None:
            host, path = cut(URLS[r.id])
            verdict, rule = brute(RULES, host, path)
            assert (r.host, r.path, r.verdict, r.rule) == (host, path, verdict, rule)
    assert judge_urls(pages.limit(0), rules).count() == 0
    everything = judge_urls(pages, rules.limit(0), default=BLOCK)
    assert {(r.rule, r.verdict) for r in everything.collect()} == {(None, BLOCK)}


def random_rules(rng, n):
    out = []
    for _ in range(n):
        host = ".".join(rng.choice(["a", "b", "org", "com", ""]) for _ in range(rng.randint(0, 3))).strip(".")
        path = rng.choice(["", "/", "/x", "/x/", "/x/y", "x", "//", "/xy"]) + rng.choice(["", "/", "y"])
        out.append((rng.choice([ALLOW, BLOCK]), host, path))
    return out


def test_trie_against_brute_force():
    rng = random.Random(11)
    for _ in range(300):
        rules = random_rules(rng, rng.randint(0, 12))
        trie = UrlTrie(rules)
        for _ in range(30):
            host = ".".join(rng.choice(["a", "b", "org", "com", "org", ""]) for _ in range(rng.randint(1, 4)))
            path = "".join(rng.choice(["/", "x", "y", "/x", ""]) for _ in range(rng.randint(0, 5)))
            path = path if path.startswith("/") else ""
            got = trie.find(host, path)
            assert ((got[0], got[1]) if got else (ALLOW, None)) == brute(rules, host, path), (rules, host, path)


def test_blocks_of_rules_give_the_same(spark):
    ship_package(spark)
    rng = random.Random(5)
    rules = random_rules(rng, 60)
    urls = [f"http://{'.'.join(rng.choice(['a', 'b', 'org', 'com']) for _ in range(3))}/{'/'.join(rng.choice('xy') for _ in range(3))}" for _ in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    one = judge_urls(pages, table).collect()
    many = judge_urls(pages, table, trie_rules=20).collect()
    assert sorted(one) == sorted(many)
    assert all((r.verdict, r.rule) == brute(rules, *cut(urls[r.id])) for r in one)


def test_unknown_verdict(spark):
    with pytest.raises(ValueError):
        judge_urls(spark.createDataFrame([(1, "a://b")], "page_id long, url string"), spark.createDataFrame([("maybe", "b", "")], "verdict string, host string, path string"))
