"""Hosts, paths, rules and reputation."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from patronage.llm.urls import UrlRule, host_of, judged, levels, path_of, reputation

URLS = {
    "https://Example.COM/en/1?q#f": ("example.com", "/en/1"), "http://a.b": ("a.b", ""), "http://a.b?x/y": ("a.b", ""),
    "x://h#/p": ("h", ""), "no scheme": ("", ""), "": ("", ""), "a://b://c/d": ("b:", "//c/d"),
    "http://u:p@h.co.uk:80/x": ("u:p@h.co.uk:80", "/x"), "http://ÄB.de/Ü": ("Äb.de", "/Ü"), "http:///p": ("", "/p"),
    "://h/p": ("h", "/p"),
}
RULES = [UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/")]


def test_parts(spark):
    table = spark.createDataFrame([(url,) for url in [*URLS, None]], "url string")
    found = table.select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).collect()
    assert {row["url"]: (row["h"], row["p"]) for row in found} == URLS | {None: ("", "")}


def test_levels(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.y.co.uk": ("y.co.uk", "co.uk"), "com": ("com", "com"),
             "u@h.example.org:8080": ("example.org", "org")}
    table = spark.createDataFrame([(host,) for host in hosts], "host string")
    found = table.select("host", *[column.alias(name) for name, column in levels(F.col("host")).items()]).collect()
    assert {row["host"]: (row["domain"], row["suffix"]) for row in found} == hosts


def reputation_by_hand(counts: dict) -> dict:
    """(n, bad) per (host, domain, suffix)."""
    def total(rows):
        return sum(n for n, _ in rows), sum(bad for _, bad in rows)

    def strength(groups):
        excess = sum((b - n * p) ** 2 - n * p * (1 - p) for n, b, p in groups)
        room = sum(n * p * (1 - p) * (n - 1) for n, b, p in groups)
        return 1 / min(max(excess / room if room else 0.001, 0.001), 0.999) - 1

    def shrunk(groups):
        k = strength(groups.values())
        return {name: (b + k * p) / (n + k) for name, (n, b, p) in groups.items()}, k

    n, bad = total(counts.values())
    suffixes = {s: (*total([c for k, c in counts.items() if k[2] == s]), bad / n) for _, _, s in counts}
    suffix_means, _ = shrunk(suffixes)
    domains = {(d, s): (*total([c for k, c in counts.items() if k[1:] == (d, s)]), suffix_means[s]) for _, d, s in counts}
    domain_means, _ = shrunk(domains)
    means, k = shrunk({key: (*counts[key], domain_means[key[1:]]) for key in counts})
    return {key[0]: mean - 1.645 * math.sqrt(mean * (1 - mean) / (counts[key][0] + k + 1)) for key, mean in means.items()}


def test_reputation(spark):
    counts = {("a.x.com", "x.com", "com"): (40, 38), ("b.x.com", "x.com", "com"): (3, 3),
              ("c.y.com", "y.com", "com"): (50, 2), ("d.z.org", "z.org", "org"): (30, 1), ("e.z.org", "z.org", "org"): (1, 1)}
    rows = [(key[0], int(i < bad)) for key, (n, bad) in counts.items() for i in range(n)] + [("e.z.org", None)]
    found = {row["host"]: row["bound"] for row in reputation(spark.createDataFrame(rows, "host string, bad int")).hosts.collect()}
    assert found == pytest.approx(reputation_by_hand(counts))
    assert found["a.x.com"] > 0.5 > found["c.y.com"] and found["e.z.org"] < 0.5


def test_judged(spark):
    outcomes = spark.createDataFrame(
        [(f"http://bad.net/{i}", 1) for i in range(60)] + [(f"http://good{i % 9}.org/{i}", 0) for i in range(90)]
        + [(None, 1), ("http://good1.org/x", None)], "url string, bad int")
    pages = {1: ("http://bad.net/zzz", None, "block"), 2: ("http://good1.org/", None, "allow"),
             3: ("http://m.example.com/en/x", "example.com/en/", "block"),
             4: ("http://www.example.com/en/x", "www.example.com/en/", "allow"), 5: ("http://x.com/", "com/", "allow"),
             6: ("http://x.com", None, "allow"), 7: (None, None, "allow"), 8: ("http://unseen.net/a", None, "block"),
             9: ("http://notexample.com/en/", "com/", "allow")}
    table = spark.createDataFrame([(i, row[0], "x") for i, row in pages.items()] + [(None, "http://bad.net/", "x")],
                                  "page_id long, url string, host string")
    found = judged(table, "page_id", "url", outcomes, RULES).collect()
    assert {row["page_id"]: (row["rule"], row["verdict"]) for row in found} == {
        i: row[1:] for i, row in pages.items()} | {None: (None, "block")}
    nothing = judged(table, "page_id", "url", outcomes.limit(0), RULES).collect()
    assert {row["verdict"] for row in nothing if row["rule"] is None} == {"allow"}
    assert judged(table.limit(0), "page_id", "url", outcomes, RULES).collect() == []


def test_hosts_without_labels_are_judged_by_the_next_rung(spark):
    outcomes = spark.createDataFrame(
        [(f"http://h{i % 20}.bad{i % 3}.net/{i}", 1) for i in range(1000)] + [("http://one.bad0.net/x", 1)]
        + [(f"http://h{i % 20}.good{i % 3}.org/{i}", 0) for i in range(1000)], "url string, bad int")
    pages = {1: ("http://one.bad0.net/y", "block"), 2: ("http://new.bad0.net/y", "block"), 3: ("http://new.good0.org/", "allow"),
             4: ("http://new.net/", "block"), 5: ("http://new.info/", "allow"), 6: ("no scheme", "allow"),
             7: ("http://new.org/", "allow"), 8: ("http:///bad0.net", "allow")}
    table = spark.createDataFrame([(i, url) for i, (url, _) in pages.items()], "page_id long, url string")
    found = judged(table, "page_id", "url", outcomes, []).collect()
    assert {row["page_id"]: row["verdict"] for row in found} == {i: verdict for i, (_, verdict) in pages.items()}
    # a rung's bound is that of a host of it with no labels, counted with the others
    counts = {(f"h{h}.{kind}{d}.{top}", f"{kind}{d}.{top}", top): (len(hits), len(hits) * bad)
              for kind, top, bad in (("bad", "net", 1), ("good", "org", 0)) for h in range(20) for d in range(3)
              if (hits := [i for i in range(1000) if i % 20 == h and i % 3 == d])}
    counts["one.bad0.net", "bad0.net", "net"] = (1, 1)
    unseen = {("new.bad0.net", "bad0.net", "net"): (0, 0), ("new.net", "new.net", "net"): (0, 0),
              ("new.info", "new.info", "info"): (0, 0)}
    by_hand = reputation_by_hand(counts | unseen)
    known = reputation(outcomes.select(host_of(F.col("url")).alias("host"), "bad"))
    assert {row["host"]: row["bound"] for row in known.hosts.collect()} == pytest.approx(
        {host: bound for host, bound in by_hand.items() if not host.startswith("new.")})
    assert known.domains.filter("domain = 'bad0.net'").first()["bound"] == pytest.approx(by_hand["new.bad0.net"])
    assert known.suffixes.filter("suffix = 'net'").first()["bound"] == pytest.approx(by_hand["new.net"])
    assert known.overall == pytest.approx(by_hand["new.info"])


def test_pages_are_read_once_for_the_verdicts(spark):
    from patronage.llm.queries import QUERIES

    plan = QUERIES["op8_url_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [page_id") == 1
