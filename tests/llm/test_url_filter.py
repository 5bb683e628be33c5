"""Hosts, rules and shrinkage."""

import pytest
from pyspark.sql import functions as F

from logweir.llm import url_filter

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
URLS = {
    "http://A.Example.ORG/en/12?x=/es/": ("a.example.org", "/en/12", "example.org/en/1", "block"),
    "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
    "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "https://x.com/de/#f": ("x.com", "/de/", "com/de/", "block"),
    "a://b://c.com/fr/": ("b:", "//c.com/fr/", None, None),
    "http://x.org": ("x.org", "", None, None),
    "http://x.org?q": ("x.org", "", None, None),
    "no scheme/org/": ("", "", None, None),
    "http://ÀB.com/\nfr/": ("Àb.com", "/\nfr/", None, None),
    None: ("", "", None, None),
}


def test_parts_and_rules(spark):
    frame = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "id long, n long, k long")
    got = {r.url: r for r in url_filter.url_filter(frame, none, RULES).collect()}
    for url, (host, path, rule, verdict) in URLS.items():
        r = got[url]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if verdict:
            assert r.verdict == verdict
        assert r.verdict in ("allow", "block")
    assert url_filter.url_filter(frame.where("false"), none, RULES).count() == 0


def test_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.example.com": ("example.com", "com"), "com": ("com", "com"), "10.0.0.1": ("10.0.0.1", ""), "": ("", ""), "co.uk": ("co.uk", "co.uk")}
    frame = spark.createDataFrame([(h,) for h in hosts], "h string")
    for r in frame.select("h", url_filter.domain_of(F.col("h")).alias("d"), url_filter.suffix_of(F.col("h")).alias("s")).collect():
        assert (r.d, r.s) == hosts[r.h]


def test_posterior_against_plain(spark):
    pages = [(i, f"http://h{i % 7}.d{i % 3}.com/") for i in range(210)] + [(500, "http://new.d1.com/"), (501, "http://new.other.net/"), (3, "http://h3.d0.com/"), (None, "http://h1.d1.com/")]
    outcomes = [(i, 1, int(i % 7 < 4 or i % 5 == 0)) for i in range(0, 210, 2)] + [(4, 1, 0), (None, 5, 5), (9999, 3, 3)]
    got = url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "id long, n long, k long")).collect()
    assert len(got) == len(pages)
    label = {}
    for i, n, k in outcomes:
        a, b = label.get(i, (0, 0))
        label[i] = (a + n, b + k)
    sums = {}
    for i, u in set(pages):
        h = u.split("/")[2]
        n, k = label.get(i, (0, 0)) if i is not None else (0, 0)
        a, b = sums.get(h, (0, 0))
        sums[h] = (a + n, b + k)

    def level(keys, mean):
        table = {}
        for h, (n, k) in sums.items():
            a, b = table.get(keys(h), (0, 0))
            table[keys(h)] = (a + n, b + k)
        m = {c: mean(c) for c in table}
        most = sum(n * m[c] * (1 - m[c]) * (n - 1) for c, (n, k) in table.items())
        rho = min(0.9, max(0.001, sum((k - n * m[c]) ** 2 - n * m[c] * (1 - m[c]) for c, (n, k) in table.items() if n) / most))
        s = 1 / rho - 1
        return {c: (s * m[c] + k, s * (1 - m[c]) + n - k) for c, (n, k) in table.items()}

    total = [sum(x) for x in zip(*sums.values())]
    tops = level(lambda h: h.split(".")[-1], lambda c: (total[1] + 0.5) / (total[0] + 1))
    rate = lambda ab: ab[0] / sum(ab)
    domains = level(lambda h: ".".join(h.split(".")[-2:]), lambda c: rate(tops[c.split(".")[-1]]))
    hosts = level(lambda h: h, lambda c: rate(domains[".".join(c.split(".")[-2:])]))
    for r in got:
        a, b = hosts[r.host]
        bound = a / (a + b) - 1.645 * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
        assert r.bound == pytest.approx(bound, abs=1e-9)
        assert r.verdict == ("allow" if bound >= 0.5 else "block")
