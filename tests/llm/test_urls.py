"""URL rules against a plain comparison of every URL with every rule."""

import random
import re

from wavecohort.llm import urls

RULES = "host string, path string, verdict string"
PAGES = "page_id long, url string, page string, host string, hosts string, number string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host) :]).group()


def verdict(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def judged(spark, pages, rules):
    table = spark.createDataFrame([(i, u, *"ABCD") for i, u in pages], PAGES).repartition(5)
    found = urls.judged(table, spark.createDataFrame(rules, RULES))
    assert found.columns == ["page_id", "url", "page", "hosts", "number", "host", "path", "rule", "verdict"]
    return sorted(map(tuple, found.drop("page", "hosts", "number").collect()), key=str)


def test_longest_rule_of_nested_hosts_and_paths(sent):
    draw = random.Random(3)
    host = lambda: ".".join(draw.choice(["a", "b", "ab", "c"]) for _ in range(draw.randint(1, 4)))
    path = lambda: draw.choice(["", "/" + "".join(draw.choice("/xy") for _ in range(draw.randint(0, 4)))])
    rules = [(host(), path(), draw.choice(["block", "allow"])) for _ in range(300)]
    pages = [(i, draw.choice(["http://", "ftp://", ""]) + host().upper() + path() + draw.choice(["", "?q=/x", "#/y"])) for i in range(2000)]
    assert judged(sent, pages, rules) == sorted([(i, u, *verdict(u, rules)) for i, u in pages], key=str)


def test_odd_urls_hot_urls_and_repeated_rows(sent):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("x.net", "", "block"), ("ünï.org", "/ä", "block"), ("net", "/", "allow"), (" ", "/", "block")]
    odd = [None, "", "://", "http://", "http://net", "http://net/", "http://NET?/", "x://y://z.net/", "http://x.net#f", "http://xx.net", "http://.net/", "http://net./", "http://ünï.org/ä/b", "http://ÜNÏ.ORG/ä", "http://example.net:80/en/", "http://u@example.net/en/", "http://a.example.net/en/" + "p/" * 5000]
    pages = [(i, u) for i, u in enumerate(odd)] + [(None, "http://hot.example.net/en/1")] * 1500 + [(7, u) for u in odd]
    assert judged(sent, pages, rules) == sorted([(i, u, *verdict(u, [r for r in rules if r != ("net", "/", "allow")])) for i, u in pages], key=str)


def test_paths_without_a_slash_and_nulls_in_rules_fit_nothing(sent):
    rules = [("example.net", "en", "block"), (None, "/", "block"), ("", "", "block"), ("org", None, "block")]
    pages = [(1, "http://en.example.net/x"), (2, "http://example.net/en"), (3, "none"), (4, "http://a.org")]
    got = judged(sent, pages, rules)
    assert [(i, v) for i, *_, v in got] == [(1, "allow"), (2, "allow"), (3, "allow"), (4, "block")]


def test_no_pages_or_no_rules(sent):
    assert judged(sent, [], [("net", "/", "block")]) == []
    assert judged(sent, [(1, "http://a.net/")], []) == [(1, "http://a.net/", "a.net", "/", None, "allow")]
