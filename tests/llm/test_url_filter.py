"""The URL automaton against a plain reading of the rules."""

import random
import re

import pytest

from gridloom.llm.url_filter import Rule, filter_urls

RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
    Rule("block", "*.shop.example", "/a*/x/"),
]


def glob(text, star):
    return star.join(re.escape(p) for p in text.split("*"))


def plain(url):
    found = re.search("://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (found[1], found[2]) if found else ("", "")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [
        r
        for r in RULES
        if re.fullmatch("([^/]*[.])?" + glob(r.host, "[^/]*"), host, re.S)
        and re.match(glob(r.path, ".*"), path, re.S)
    ]
    rule = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, rule and rule.text, rule.action if rule else "allow"


def urls():
    rng = random.Random(3)
    hosts = ["net", "a.net", "example.net", "x.Example.NET", "examplenet", "xexample.com", "example.com", "org", "m.org"]
    hosts += ["b.shop.example", "shop.example", "a.net.example.org", "", "net.", "é.net"]
    paths = ["", "/", "/en/", "/en", "/EN/1", "/de/a/fr/", "/fr/", "/fr/x.net/", "/abc/x/", "/a/y/x/z", "/x.net/"]
    tails = ["", "?q=/en/", "#/de/", "?x://net/", "\n"]
    out = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(400)]
    return [*out, None, "", "no scheme", "a://b://net/", "http://" + "a" * 70_000 + ".net/" + "b" * 70_000, "mailto:x@net/"]


def test_matches_the_rules(spark):
    pages = [(i, u, "html", "clash") for i, u in enumerate(urls())]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, verdict string")
    found = filter_urls(frame, RULES).collect()
    assert len(found) == len(pages)
    for row in found:
        assert (row.host, row.path, row.rule, row.verdict) == plain(row.url), row.url[:200]


def test_many_rules_and_words(spark):
    rules = [Rule("block", f"host{i}.example", "/") for i in range(60)]
    frame = spark.createDataFrame([(f"http://a.host{i}.example/x",) for i in range(70)], "url string")
    found = {r.url: r.verdict for r in filter_urls(frame, rules).collect()}
    assert sum(v == "block" for v in found.values()) == 60


def test_limits_and_empty(spark):
    assert filter_urls(spark.createDataFrame([], "url string"), RULES).count() == 0
    assert {r.verdict for r in filter_urls(spark.createDataFrame([("http://net/",)], "url string"), [], default="block").collect()} == {"block"}
    with pytest.raises(ValueError, match="not a rule"):
        filter_urls(spark.createDataFrame([], "url string"), [Rule("block", "net", "x")])
    with pytest.raises(ValueError, match="too many"):
        filter_urls(spark.createDataFrame([], "url string"), [*[Rule("block", "x" * 2000, "/")] * 1100])
