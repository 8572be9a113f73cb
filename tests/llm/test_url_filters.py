"""The URL query itself: rules come first, then the list."""

import re

from foliant.llm import url_filters

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def expected(url):
    """host, path, rule, verdict, listed of a URL, plainly."""
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = "" if rest is None else re.match("[^/?#]*", rest)[0]
    path = "" if rest is None else re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    sites = [f"{s}.{d}" for s in url_filters.SITES for d in url_filters.DOMAINS]
    listed = [s + "/" for s in sites if (host == s or host.endswith("." + s)) and path.startswith("/")]
    if fits:
        return host, path, max(fits)[1], max(fits)[2], None
    return host, path, None, "block" if listed else "allow", listed[0] if listed else None


def test_rules_decide_on_listed_hosts(spark, tmp_path):
    hosts = ["www.cheap-pills.example.com", "spam-farm.example.org", "Casino-Win.Example.NET", "free-bets.example.com", "xspam-farm.example.org", "news.example.org", "NET", "a.net.example.com"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/de/612", "/fr/x?y", "/en/#z", "/FR/", "?a://b")]
    urls += [None, "", "no scheme", "://", "a://b://c/fr/", "http://example.org/fr/\n", "http://ex ample.org/fr/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (0, urls[0])]
    spark.createDataFrame([(*r, "h", "k") for r in rows], "page_id long, url string, host string, key string").write.parquet(f"{tmp_path}/pages.parquet")
    found = url_filters.op1_url_filters(spark, str(tmp_path))
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "listed"]
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found.collect()), key=order) == sorted([(i, *expected(u)) for i, u in rows], key=order)
    page = {r["page_id"]: r for r in found.collect()}
    assert (page[2]["rule"], page[2]["verdict"]) == ("example.com/de/", "block")  # on a listed host
    assert (page[10]["rule"], page[10]["verdict"]) == ("org/fr/", "allow")  # although its host is listed


def test_entries_without_key_or_pages(spark):
    rules = spark.createDataFrame([(None, "block"), ("a.test/", "allow")], "key string, verdict string")
    listed = spark.createDataFrame([("a.test/", "block"), ("b.test/", "block"), ("b.test/x/", "allow")], "key string, verdict string")
    pages = spark.createDataFrame([(1, "h://a.test/q"), (2, "h://b.test/q"), (3, "h://b.test/x/q")], "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"], r["listed"]) for r in url_filters.judge(pages, rules, listed).collect()}
    assert found == {1: ("a.test/", "allow", None), 2: (None, "block", "b.test/"), 3: (None, "allow", "b.test/x/")}
    assert url_filters.judge(pages.limit(0), rules, listed).count() == 0
