import random

import pytest

from ledgerloom.llm import url_filter
from ledgerloom.llm.queries import URL_RULES, op4_url_filters
from ledgerloom.llm.url_filter import Rule, filter_urls, rule_index, token_counts

SF = "/root/testdata/sf0.01"


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min((i for i, c in enumerate(rest) if c in "/?#"), default=len(rest))
    path = rest[at:]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at]), path[: min((i for i, c in enumerate(path) if c in "?#"), default=len(path))]


def judged(url, rules, default="allow"):
    """(host, path, rule, verdict) with every rule tried."""
    host, path = parts(url)
    fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host) or not r.host) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.text), r.verdict != "block", r.text), default=None)
    return host, path, best and best.text, best.verdict if best else default


def result(df):
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in df.orderBy("n").collect()]


URLS = [
    None, "", "no scheme", "http://", "://a.com/en/1", "HTTP://Example.COM/en/70?x=1", "http://example.com/en/8", "http://sub.example.com/en/7", "http://notexample.com/en/7", "http://example.net/de/8#f",
    "http://example.net/de/9", "http://x.org/es/", "http://x.org/es", "http://x.org?/es/", "http://com/en/1", "http://exämple.com/en/1", "http://a.com/EN/1", "http://a.com//en/1", "http://example.com:80/en/7",
    "http://a.com/en/" + "x" * 200_000, "http://a.com/en/://b.org/es/", "http://user@a.com/en/",
]


@pytest.mark.parametrize("literal", [256, 0])
def test_same_as_trying_every_rule(spark, monkeypatch, literal):
    monkeypatch.setattr(url_filter, "LITERAL", literal)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, URLS[5], URLS[5]])], "n long, url string")
    assert result(filter_urls(pages, URL_RULES)) == [judged(u, URL_RULES) for u in [*URLS, URLS[5], URLS[5]]]


@pytest.mark.parametrize("literal", [10_000, 5])
def test_long_lists_and_ties(spark, monkeypatch, literal):
    monkeypatch.setattr(url_filter, "LITERAL", literal)
    rng = random.Random(3)
    hosts = [f"{a}.{b}" for a in ("x", "y", "news") for b in ("com", "org", "example.net")]
    rules = [Rule(rng.choice(["block", "allow"]), rng.choice([*hosts, "com", "org", ""]) + rng.choice(["", "/", "/a", "/a/b", "/a/b/", f"/p{rng.randrange(30)}"])) for _ in range(400)]
    rules += [Rule("allow", "x.com/a"), Rule("block", "x.com/a"), Rule("block", "x.com/a")]
    rules = [r for r in rules if r.path or r.host]
    urls = [f"http://{rng.choice(['', 'www.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/a/b', '/a/b/c'])}{rng.choice(['', f'/p{rng.randrange(30)}', '?q'])}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "n long, url string")
    assert result(filter_urls(pages, rules)) == [judged(u, rules) for u in urls]


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(u,) for u in ("http://a.com/en/1", "http://b.com/en/2", "http://a.org/en/3")], "url string")
    rules = [Rule("block", "a.com/en/")]
    counts = token_counts(pages, rules)
    assert counts == {"h:a": 2, "h:com": 2, "p:en": 3} and list(rule_index(rules, counts)) == ["h:a"]
    out = filter_urls(pages, rules).select("n_candidates").collect()
    assert sum(r["n_candidates"] for r in out) == 2


def test_clashing_names_and_empty_input(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/1", "old", "keep")], "row long, url string, verdict string, k0 string")
    out = filter_urls(pages, URL_RULES)
    assert out.columns == ["row", "url", "k0", "host", "path", "rule", "verdict", "n_candidates"]
    assert tuple(out.first()) == (1, "http://a.com/en/1", "keep", "a.com", "/en/1", "com/en/", "block", 1)
    assert filter_urls(pages.limit(0), URL_RULES).count() == 0
    assert filter_urls(pages, []).first()["verdict"] == "allow"


def test_whole_table(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op4_url_filters(spark, SF).collect()
    assert len(rows) == len(pages)
    assert all((r["host"], r["path"], r["rule"], r["verdict"]) == judged(pages[r["page_id"]], URL_RULES) for r in rows)
