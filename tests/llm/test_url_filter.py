from __future__ import annotations

import pytest

from shelfmark.llm.queries import URL_RULES
from shelfmark.llm.url_filter import DigestIndex, asked_of, build, filter_urls

RULES = "host string, path string, verdict string"
URLS = [
    "https://www.example.com/en/a", "https://example.com/en/", "http://EXAMPLE.com/en/x?y#z", "http://sub.www.example.com/en/q", "https://example.net/es/1", "https://example.net/ES/1", "ftp://net/fr/", "https://a.b.net/fr/x",
    "https://notexample.com/en/", "https://example.org/", "example.com/en/", "", None, "://", "https://", "https://com", "https://com/", "https://com?/", "https://.com/", "https://a..com/x", "x://y://com/en/", "https://example.com:80/en/", "https://ÄB.com/É",
]


def brute(url, rules):
    _, found, rest = (url or "").partition("://")
    host = path = ""
    if found:
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_equals_brute_force(spark, max_bytes):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS rule")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, spark.createDataFrame(URL_RULES, RULES), max_bytes).collect()}
    assert got == {k: brute(u, URL_RULES) for k, u in enumerate(URLS)}


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_many_rules_and_repeats(spark, max_bytes):
    rules = [(f"h{k}.net", f"/p{k % 7}/", "block" if k % 2 else "allow") for k in range(500)] + [("h1.net", "/p1/", "allow")]
    urls = [f"https://a.h{k}.net/p{k % 5}/x" for k in range(500)]
    pages = spark.createDataFrame([(k % 400, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = sorted((r.page_id, r.host, r.rule or "", r.verdict) for r in filter_urls(pages, spark.createDataFrame(rules, RULES), max_bytes).collect())
    want = [(k % 400, *brute(u, rules)) for k, u in enumerate(urls)]
    # Equal rules count once, block over allow.
    want = sorted((k, h, r or "", "block" if r == "h1.net/p1/" else v) for k, h, _, r, v in want)
    assert got == want


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_capitals_of_rules_are_lowered_like_those_of_urls(spark, max_bytes):
    rules = [("ÄB.Com", "/", "block"), ("x.Org", "/Q/", "block")]
    urls = ["https://ÄB.com/a", "https://äb.com/a", "https://s.X.org/Q/1", "https://x.org/q/"]
    got = {r.url: r.verdict for r in filter_urls(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string"), spark.createDataFrame(rules, RULES), max_bytes).join(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "page_id").collect()}
    assert got == dict(zip(urls, ["block", "allow", "block", "allow"], strict=True))


def test_a_host_of_very_many_parts_asks_for_few_strings():
    assert asked_of("a." * 4000 + "com", "/en/x", [1, 4], [1, 2]) == ["a.com/en/", "com/en/", "a.com/", "com/"]
    assert asked_of("a..com", "/", [1], [1, 2, 3, 4]) == ["a..com/", ".com/", "com/"] and asked_of("", "", [0, 1], [1]) == []


def test_many_ranges_and_parts(spark):
    rules = [(f"h{k}.net", f"/p{k % 7}/", "block" if k % 2 else "allow") for k in range(2000)] + [("net", "/", "block")]
    urls = [f"https://a.h{k}.net/p{k % 5}/x" for k in range(0, 2000, 3)] + [None, "https://x.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, spark.createDataFrame(rules, RULES), 4096, 50).collect()}
    assert got == {k: brute(u, rules) for k, u in enumerate(urls)}


def test_a_rule_without_a_verdict_is_an_error(spark):
    pages = spark.createDataFrame([(1, "https://a.com/")], "page_id long, url string")
    for verdict in (None, "perhaps"):
        with pytest.raises(Exception, match="no verdict of a rule"):
            filter_urls(pages, spark.createDataFrame([("a.com", "/", verdict)], RULES)).collect()


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "https://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], RULES)
    assert [tuple(r) for r in filter_urls(pages, none).collect()] == [(1, "a.com", "/", None, "allow")]
    assert filter_urls(pages.limit(0), spark.createDataFrame(URL_RULES, RULES)).collect() == []


def test_equal_digests_are_told_apart_by_strings(monkeypatch):
    import shelfmark.llm.url_filter as module

    monkeypatch.setattr(module.xxhash, "xxh64_intdigest", lambda x: 7)
    index = DigestIndex.of(build([("a/", "allow"), ("b/", "block")]))
    assert [int(x >= 0) for x in index.find([b"a/", b"b/", b"c/"])] == [1, 1, 0]
