"""Rules and host reputation against a plain version."""

import math
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortforge.llm.url_filter import RULES, SECOND_LEVEL, domain_keys, filter_urls, host_reputation, oracle_sql

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def keys(host):
    """Registered domain and public suffix."""
    bare = host.rpartition("@")[2]
    bare = bare[: bare.rindex(":")] if ":" in bare and bare.rpartition(":")[2].strip("0123456789") == "" else bare
    bare = bare.rstrip(".")
    labels = bare.split(".")
    if bare.startswith("[") and bare.endswith("]") or len(labels) == 4 and all(x.isdigit() and x.isascii() and len(x) <= 3 for x in labels):
        return bare, "ip"
    deep = 2 if ".".join(labels[-2:]) in SECOND_LEVEL else 1
    return ".".join(labels[-deep - 1 :]), ".".join(labels[-deep:])


@pytest.mark.parametrize(
    "host, domain, suffix",
    [
        ("a.co.uk", "a.co.uk", "co.uk"), ("x.b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("www.example.com", "example.com", "com"), ("10.0.0.1", "10.0.0.1", "ip"), ("10.0.0.1:80", "10.0.0.1", "ip"),
        ("[2001:db8::1]:443", "[2001:db8::1]", "ip"), ("me:pw@shop.net:8080", "shop.net", "net"), ("example.org.", "example.org", "org"), ("localhost", "localhost", "localhost"), ("", "", ""), ("1000.0.0.1", "0.1", "1"),
    ],
)
def test_registered_domain(spark, host, domain, suffix):
    assert keys(host) == (domain, suffix)
    d, x = domain_keys(F.col("host"))
    assert tuple(spark.createDataFrame([(host,)], "host string").select(d, x).first()) == (domain, suffix)


def level(keys, parent_mean):
    """Posterior mean and weight by key, from {key: (n, bad, parent)}."""
    excess = scale = 0.0
    for n, bad, parent in keys.values():
        if n:
            q = parent_mean[parent]
            excess += (bad - n * q) ** 2 - n * q * (1 - q)
            scale += n * (n - 1) * q * (1 - q)
    rho = max(excess / scale, 1e-9) if scale > 0 else 0.5
    strength = min(max(1 / rho - 1, 2.0), 200.0)
    return {k: ((bad + strength * parent_mean[p]) / (n + strength), n + strength) for k, (n, bad, p) in keys.items()}


def plain(urls, z=1.645):
    seen = [(*parts(u), *rule_of(*parts(u))) for u in urls]
    hosts, domains, suffixes = {}, defaultdict(lambda: [0, 0, ""]), defaultdict(lambda: [0, 0, 0])
    counted = defaultdict(lambda: [0, 0])
    for host, _, _, verdict in seen:
        counted[host][0] += verdict is not None
        counted[host][1] += verdict == "block"
    for host, (n, bad) in counted.items():
        domain, suffix = keys(host)
        hosts[host] = (n, bad, domain)
        for table, key, up in ((domains, domain, suffix), (suffixes, suffix, 0)):
            table[key][0] += n
            table[key][1] += bad
            table[key][2] = up
    total = {0: (sum(n for n, _, _ in suffixes.values()), sum(b for _, b, _ in suffixes.values()))}
    mean = {0: (total[0][1] + 1) / (total[0][0] + 2)}
    by_suffix = level(suffixes, mean)
    by_domain = level(domains, {k: m for k, (m, _) in by_suffix.items()})
    by_host = level(hosts, {k: m for k, (m, _) in by_domain.items()})
    out = []
    for host, path, rule, verdict in seen:
        m, w = by_host[host]
        lower = max(m - z * math.sqrt(m * (1 - m) / (w + 1)), 0)
        out.append((host, path, rule, verdict or ("block" if lower > 0.5 else "allow"), round(lower, 5)))
    return out


URLS = (
    [f"http://a.bad.net/x/{i}" for i in range(40)]
    + [f"HTTPS://Sub.Example.NET/en/{i}?q=1#f" for i in range(30)]
    + ["http://example.net/de/", "http://example.net/en", "ftp://example.com/de/a", "ftp://www.EXAMPLE.com/fr/a", "http://notexample.com/de/", "http://x.org/fr/1", "http://x.org/fr", "http://net", "http://net/", "http://anet/"]
    + ["http://", "://host/p", "no scheme", None, "", "a://b://c/d", "http://h?x=/y", "http://h#/y", "http://h/p\nq?z", "http://ÄB.org/fr/ü"]
    + [f"http://b.bad.net?n={i}" for i in range(5)]
    + ["http://a.co.uk/x", "http://b.co.uk/", "http://10.0.0.1/a", "http://10.0.0.1:8080/a", "http://u:p@bad.net:99/q", "http://bad.net./", "http://[::1]:8/x", "http://example.net:80/en/"]
)


def test_equals_plain_version(spark):
    pages = spark.createDataFrame([(i, u, "<html>") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    got = [(r.host, r.path, r.rule, r.verdict, round(r.bad_lower, 5)) for r in filter_urls(pages).orderBy("page_id").collect()]
    want = plain(URLS)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(g[4] - w[4]) < 2e-5 for g, w in zip(got, want, strict=True))


def test_reputation_decides_pages_without_a_rule(spark):
    urls = [f"http://h{i % 30}.net/{i}" for i in range(900)] + [f"http://o{i % 9}.org/fr/{i}" for i in range(300)] + ["http://h3.net?late", "http://clean.org/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in filter_urls(pages).collect()}
    assert (got[1200].rule, got[1200].verdict) == (None, "block")
    assert (got[1201].rule, got[1201].verdict) == (None, "allow")


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert filter_urls(empty).collect() == []
    rows = [(1, "http://a.net/"), (1, "http://a.net/"), (None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "n", "bad", "mean", "top")})
    got = sorted((r.page_id or 0, r.host, r.rule, r.verdict) for r in filter_urls(pages).collect())
    assert [g[0] for g in got] == [0, 1, 1]
    assert got[1] == got[2] == (1, "a.net", "net/", "block")


def test_a_host_of_most_pages(spark, monkeypatch):
    """Hosts of a large share of the pages are joined by broadcast, the others by a shuffle, with the same rows."""
    from cohortforge.llm import shared

    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, *["http://a.bad.net/x"] * 200])], "page_id long, url string")
    want = sorted(tuple(r) for r in filter_urls(pages).collect())
    monkeypatch.setattr(shared, "HOT_SHARE", 0.2)
    monkeypatch.setattr(shared, "max", lambda a, b: b, raising=False)  # without the floor of 10,000 rows
    assert sorted(tuple(r) for r in filter_urls(pages).collect()) == want


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = filter_urls(pages)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "NestedLoop", "Cartesian"))


def test_shrinkage_is_stronger_with_fewer_labels(spark):
    hosts = spark.createDataFrame([("a.x.com", 1, 1), ("b.x.com", 100, 100), ("c.y.com", 100, 0), ("d.y.com", 0, 0)], "host string, n long, bad long")
    mean = {r.host: r["mean"] for r in host_reputation(hosts).collect()}
    assert mean["b.x.com"] > mean["a.x.com"] > mean["d.y.com"] > mean["c.y.com"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    want = sorted(con.sql(oracle_sql()).fetchall())
    got = sorted(tuple(r) for r in filter_urls(spark.read.parquet(f"{SF}/pages.parquet")).collect())
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert all(abs(a - b) <= 1e-6 for g, w in zip(got, want, strict=True) for a, b in zip(g[6:], w[6:], strict=True))


def test_sql_on_odd_urls(spark):
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(URLS)))
    want = sorted(con.sql(oracle_sql()).fetchall())
    got = sorted(tuple(r) for r in filter_urls(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")).collect())
    assert [g[:6] for g in got] == [w[:6] for w in want]
