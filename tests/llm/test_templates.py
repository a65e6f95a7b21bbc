"""Hosts, paths and rules against plain Python; the tree's wildcards, merges and verdicts."""

import re

from quillpanel.llm import templates

SCHEMA = "page_id long, url string, html string, host string, `rule` int, parts string, n int"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "own", 3, "p", 1) for i, u in enumerate(urls)], SCHEMA)


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest)[0][len(host) :]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fitting = [r for r in templates.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fitting, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


ODD = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "https://NET/x", "http://a.net/en/1", "http://example.net/en/", "http://WWW.Example.NET/en/a?b#c",
    "http://x.example.net/de/", "http://example.com/de/1", "http://badexample.com/de/1", "http://example.com/de", "http://a.org/fr/2", "http://a.org?x=/fr/",
    "http://a.org#/fr/", "http://a.org/fr/#?", "a://b://c.net/d", "http://net.com/", "http://ÄÖ.net/É", "http://h/" + "a/" * 40, "http://h/" + "7" * 5000, "://net/", "http://a.net\n/x",
]


def test_hosts_paths_rules(spark):
    rows = templates.judged(pages(spark, ODD + ODD)).collect()
    assert len(rows) == 2 * len(ODD)
    for r in rows:
        host, path, rule, verdict = plain(ODD[r.page_id % len(ODD)])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert templates.judged(pages(spark, [])).count() == 0


def test_depth_is_bounded(spark):
    found = {r.template for r in templates.judged(pages(spark, ["http://h/" + "a/" * 40, "http://h/" + "a/" * 50])).collect()}
    assert found == {"/a" * templates.LEVELS + "/**"}


def test_tree(spark):
    sections = [f"http://h.example.com/{s}/{i}" for s in ("de", "en", "fr") for i in range(200)]  # alike, one is blocked
    other = [f"http://h.example.com/static/file{i}/part/x" for i in range(200)]  # goes on in another way
    rare = [f"http://i.example.com/user/{w}" for w in (f"{a}{b}name" for a in "abcdefgh" for b in "abcdefgh")]
    mixed = [f"http://j.net/{s}/{i}" for s in ("a", "b") for i in range(100)]
    rules = (*templates.RULES, templates.Rule("allow", "j.net/b/"))
    got = {}
    for r in templates.judged(pages(spark, sections + other + rare + mixed), rules).collect():
        got.setdefault((r.host, r.template), []).append(r)
    assert {h: {t for g, t in got if g == h} for h, _ in got} == {
        "h.example.com": {"/+number/#", "/static/file#/part/x"},
        "i.example.com": {"/user/*"},
        "j.net": {"/a/#", "/b/#"},  # labels tell these apart
    }
    assert all(r.verdict == "block" for r in got["h.example.com", "/+number/#"])
    assert all(r.verdict == "allow" for r in got["h.example.com", "/static/file#/part/x"] + got["i.example.com", "/user/*"])


def test_little_evidence_does_not_reject(spark):
    urls = [f"http://k.example.com/{s}/{i}" for s in ("de", "en") for i in range(10)] + [f"http://l.org/fr/{i}" for i in range(40)]
    assert all(r.verdict == "allow" for r in templates.judged(pages(spark, urls)).collect() if r.rule is None)


def test_allowed_pages(spark):
    df = pages(spark, ["http://a.net/x", "http://a.com/x", None])
    kept = templates.allowed_pages(df)
    assert kept.columns == df.columns and sorted(r.page_id for r in kept.collect()) == [1, 2]
