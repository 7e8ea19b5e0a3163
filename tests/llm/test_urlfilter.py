"""Operator 3 against brute force."""

import random

import pytest

from plumbline.llm import urlfilter as U


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        after = rest[cut:]
        path = after[: min([i for i in (after.find(c) for c in "?#") if i >= 0], default=len(after))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host)), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else default


def urls():
    rng = random.Random(4)
    hosts = ["net", "example.net", "blog.EXAMPLE.net", "notexample.net", "a.org", "org", "x.example.com", "example.com.", "", "a..net", "net.example", "é.org"]
    tails = ["", "/", "/en/", "/en", "/en/1?x=/de/", "/de/2#top", "/fr/x", "?q", "#f/en/", "/EN/"]
    out = [None, "", "no scheme/en/", "://", "http://", "a://b://net/"]
    out += [f"{rng.choice(['http', 'https', ''])}://{h}{t}" for h in hosts for t in tails]
    return out + ["http://hot.example.net/en/1"] * 50


@pytest.mark.parametrize("rules", [U.RULES, [], [*U.RULES, U.Rule("example.net", "/", "block"), U.Rule("blog.example.net", "/en/1", "block"), U.Rule("com", "/", "block"), U.Rule("a.org", "", "block")]])
@pytest.mark.parametrize("chunk", [100_000, 2])
def test_equals_brute_force(spark, rules, chunk):
    rows = list(enumerate(urls()))
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in rows], "page_id long, url string, host string, key string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, rules, max_rules=chunk).collect()}
    assert got == {i: brute(u, rules) for i, u in rows}


def test_empty_and_wrong_rules(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(pages, U.RULES).count() == 0
    with pytest.raises(ValueError):
        U.judge(pages, [U.Rule("Net", "/", "block")])
