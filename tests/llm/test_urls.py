"""URL rules and host reputation."""

import pytest
from pyspark.sql import functions as F

from custvalue.llm import urls
from custvalue.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, host string, n int"


def judged(spark, rows, outcomes=(), **settings):
    pages = spark.createDataFrame([(i, u, "clash", 0) for i, u in rows], SCHEMA)
    known = spark.createDataFrame(list(outcomes), "page_id long, bad int")
    return urls.filter_urls(pages, known, URL_RULES, urls.Reputation(**settings))


@pytest.mark.parametrize(
    "url,host,path,rule",
    [
        ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
        ("https://x.www.example.com/en/1", "x.www.example.com", "/en/1", "www.example.com/en/"),
        ("https://notexample.com/en/1", "notexample.com", "/en/1", "com/"),
        ("http://example.com", "example.com", "", None),
        ("http://example.com?x=/en/", "example.com", "", None),
        ("ftp://b.net/es/a#b", "b.net", "/es/a", "net/es/"),
        ("http://net/fr/", "net", "/fr/", "net/fr/"),
        ("http://b.net/ES/", "b.net", "/ES/", None),
        ("a://b://c/d", "b:", "//c/d", None),
        ("no scheme/en/", "", "", None),
        ("", "", "", None),
        (None, "", "", None),
        ("http://ÄB.net/es/é", "Äb.net", "/es/é", "net/es/"),
    ],
)
def test_rules(spark, url, host, path, rule):
    row = judged(spark, [(1, url)]).first()
    assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
    actions = {r.pattern: r.action for r in URL_RULES}
    assert row["verdict"] == actions.get(rule, "allow")


def slow_strength(children, s):
    children = [(n, x, m) for n, x, m in children if n and 0 < m < 1]
    if len(children) < 2:
        return s.most_strength
    total = sum(n for n, _, _ in children)
    spread = sum(n * (x / n - m) ** 2 / (m * (1 - m)) for n, x, m in children)
    free = total - sum(n * n for n, _, _ in children) / total - (len(children) - 1)
    rho = (spread - (len(children) - 1)) / free if free > 0 else 0
    return round(1 / min(1 / (1 + s.least_strength), max(1 / (1 + s.most_strength), rho)) - 1, 9)


def test_posterior_equals_the_formulas_and_blocks_bad_hosts(spark):
    s = urls.Reputation(max_bad=0.5)
    counts = {"bad.x.org": (60, 58), "good.x.org": (300, 3), "few.x.org": (1, 1), "none.x.org": (0, 0), "a.y.co.uk": (50, 10), "10.0.0.1": (5, 0), "z.org": (9, 0)}
    rows, outcomes, i = [], [], 0
    for host, (n, bad) in counts.items():
        for k in range(max(n, 2)):
            i += 1
            rows.append((i, f"http://{host}/p/{k}"))
            if k < n:
                outcomes.append((i, int(k < bad)))
    outcomes += outcomes[:20] + [(None, 1), (10**6, None), (1, None)]
    got = {r["host"]: r for r in judged(spark, rows, outcomes).distinct().collect()}
    site = {"a.y.co.uk": ("y.co.uk", "co.uk"), "10.0.0.1": ("10.0.0.1", ""), "z.org": ("z.org", "org")}
    level = lambda h: site.get(h, ("x.org", "org"))
    total, allbad = sum(n for n, _ in counts.values()), sum(b for _, b in counts.values())
    top = (allbad + 0.5) / (total + 1)

    def sums(key):
        out = {}
        for h, (n, x) in counts.items():
            a, b = out.get(key(h), (0, 0))
            out[key(h)] = (a + n, b + x)
        return out

    suffixes, domains = sums(lambda h: level(h)[1]), sums(level)
    s1 = slow_strength([(n, x, top) for n, x in suffixes.values()], s)
    mean1 = {k: (x + s1 * top) / (n + s1) for k, (n, x) in suffixes.items()}
    s2 = slow_strength([(n, x, mean1[k[1]]) for k, (n, x) in domains.items()], s)
    mean2 = {k: (x + s2 * mean1[k[1]]) / (n + s2) for k, (n, x) in domains.items()}
    s3 = slow_strength([(n, x, mean2[level(h)]) for h, (n, x) in counts.items()], s)
    for host, (n, x) in counts.items():
        mean = (x + s3 * mean2[level(host)]) / (n + s3)
        bound = max(0, mean - s.z * (mean * (1 - mean) / (n + s3 + 1)) ** 0.5)
        assert (got[host]["n"], got[host]["bad"]) == (n, x)
        assert got[host]["bound"] == pytest.approx(bound, abs=1e-12)
        assert got[host]["verdict"] == ("block" if bound > 0.5 else "allow")
    assert got["bad.x.org"]["verdict"] == "block" and got["few.x.org"]["verdict"] == "allow"


def test_repeated_rows_and_empty_tables(spark):
    assert judged(spark, [(1, "http://a.org/"), (1, "http://a.org/"), (None, "http://a.org/")]).count() == 3
    assert judged(spark, []).collect() == []


def test_levels_of_hosts(spark):
    hosts = ["a.b.example.com", "example.com", "com", "x.co.uk", "a.x.co.uk", "co.uk", "u@a.b.org:80", "1.2.3.4", ""]
    domain, suffix = urls.site_levels(F.col("h"), urls.TWO_LABEL_SUFFIXES)
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", domain.alias("d"), suffix.alias("s")).collect()
    assert {r["h"]: (r["d"], r["s"]) for r in got} == {
        "a.b.example.com": ("example.com", "com"), "example.com": ("example.com", "com"), "com": ("com", "com"),
        "x.co.uk": ("x.co.uk", "co.uk"), "a.x.co.uk": ("x.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
        "u@a.b.org:80": ("b.org", "org"), "1.2.3.4": ("1.2.3.4", ""), "": ("", ""),
    }


def test_limit_follows_the_base_rate(spark):
    """With few bad pages everywhere, a host far above the others goes though most of its pages are good."""
    rows, outcomes, i = [], [], 0
    for host in ["worse.org", *[f"h{k}.org" for k in range(8)]]:
        for k in range(300):
            i += 1
            rows.append((i, f"http://{host}/p/{k}"))
            outcomes.append((i, int(k % 100 < (30 if host == "worse.org" else 3))))
    got = {r["host"]: r for r in judged(spark, rows, outcomes).distinct().collect()}
    top = (90 + 8 * 9 + 0.5) / (2700 + 1)
    assert got["h0.org"]["limit"] == pytest.approx(1.5 * top / (1 - top + 1.5 * top), rel=1e-12)
    assert [h for h, r in got.items() if r["verdict"] == "block"] == ["worse.org"]
    tolerant = judged(spark, rows, outcomes, max_bad=0.5).filter("verdict = 'block'")
    assert tolerant.count() == 0
