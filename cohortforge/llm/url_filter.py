"""URL filter: longest matching rule, else empirical-Bayes reputation of the host.

Built from DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.shared import join_keys, materialise

#: The rules of the query: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Public suffixes of two labels under which anyone may register, after the public list; others are the last label.
SECOND_LEVEL = tuple(
    f"{second}.{country}"
    for country, seconds in (
        ("uk", "ac co gov ltd me net org plc sch"),
        ("au", "com net org edu gov id asn"),
        ("nz", "ac co gen govt net org school"),
        ("jp", "ac ad co ed go gr lg ne or"),
        ("kr", "ac co go ne or pe re"),
        ("in", "ac co edu firm gen gov ind net org res"),
        ("br", "com edu gov net org"),
        ("cn", "ac com edu gov net org"),
        ("tw", "com edu gov idv net org"),
        ("hk", "com edu gov idv net org"),
        ("sg", "com edu gov net org per"),
        ("my", "com edu gov net org"),
        ("id", "ac co go or sch web"),
        ("th", "ac co go in or"),
        ("za", "ac co gov net org web"),
        ("il", "ac co gov net org"),
        ("tr", "com edu gov gen net org"),
        ("mx", "com edu gob net org"),
        ("ar", "com edu gob net org"),
        ("pl", "com edu gov net org"),
        ("ua", "com edu gov net org"),
    )
    for second in seconds.split()
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path.  Null or without ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + F.lit(3), F.length(url))
    ok = url.isNotNull() & (at > 0)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(ok, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(ok, path).otherwise("")


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    Rules are tried from the longest to the shortest; of two with one length the
    first in text order wins.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _level(child: DataFrame, joined: DataFrame, least: float, most: float) -> DataFrame:
    """Posterior mean and weight of each key of ``child`` from its counts and its parent's posterior mean.

    ``joined``: the rows of ``child`` with that mean as ``prior``.

    The prior strength of a level is fitted by moments: the less the rates of the
    keys differ from their parents' posterior means, beyond binomial noise, the
    stronger the pull.
    """
    noise = F.col("prior") * (1 - F.col("prior"))
    fit = joined.where("n > 0").agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("prior"), 2) - F.col("n") * noise).alias("excess"),
        F.sum(F.col("n") * (F.col("n") - 1) * noise).alias("scale"),
    )
    # Var(bad) = n q (1 - q) (1 + (n - 1) rho), hence rho; the strength of the beta prior is 1 / rho - 1
    rho = F.when(F.col("scale") > 0, F.greatest(F.col("excess") / F.col("scale"), F.lit(1e-9))).otherwise(F.lit(0.5))
    strength = fit.select(F.least(F.greatest(1 / rho - 1, F.lit(least)), F.lit(most)).alias("strength")).scalar()
    return joined.withColumn("weight", F.col("n") + strength).select(
        *child.columns,
        ((F.col("bad") + (F.col("weight") - F.col("n")) * F.col("prior")) / F.col("weight")).alias("mean"),
        "weight",
    )


def key_host(host: Column) -> Column:
    """The host without user, port and last dot, for the keys of reputation."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(bare, r"\.+$", "")


def domain_keys(host: Column, suffixes: Sequence[str] = SECOND_LEVEL) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host.

    The suffix is the last two labels where these are among ``suffixes``, else the
    last one; the domain has one label more.  An address of numbers is its own
    domain, under the suffix ``ip``; a host that is a suffix is its own domain too.
    """
    key = key_host(host)
    address = key.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$")
    labels = F.split(key, r"\.")
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (k - 1), F.lit(1)), k), ".")
    deep = tail(2).isin(*suffixes) if suffixes else F.lit(False)
    return F.when(address, key).when(deep, tail(3)).otherwise(tail(2)), F.when(address, "ip").when(deep, tail(2)).otherwise(tail(1))


def host_reputation(
    hosts: DataFrame,
    suffixes: Sequence[str] = SECOND_LEVEL,
    strength_bounds: tuple[float, float] = (2.0, 200.0),
    z: float = 1.645,
) -> DataFrame:
    """Posterior of a page's being bad, for each host.

    ``hosts`` has one row per host: ``host``, ``n`` (labelled pages), ``bad`` (of
    these).  Counts are shrunk from all pages to the public suffix, to the registered
    domain, to the host, each level by a beta prior around the level above.  ``lower``
    is the one-sided bound mean - z * sd of the host's beta posterior.  The posteriors
    of a level are written before the next one reads them twice; a domain or suffix of
    any share of the hosts is joined by broadcast.
    """
    domain, suffix = domain_keys(F.col("host"), suffixes)
    base = hosts.select("host", "n", "bad", domain.alias("domain"), suffix.alias("suffix"))
    domains = base.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("hosts"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("domains"))
    overall = tops.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("mean")).scalar()
    above = lambda table, key, count: table.select(key, F.col("mean").alias("prior"), count)
    by_suffix = materialise(_level(tops, tops.withColumn("prior", overall), *strength_bounds))
    by_domain = materialise(_level(domains, join_keys(domains, above(by_suffix, "suffix", "domains"), "suffix", "domains"), *strength_bounds))
    by_host = _level(base, join_keys(base, above(by_domain, "domain", "hosts"), "domain", "hosts"), *strength_bounds)
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return by_host.select("host", "domain", "suffix", "n", "bad", "mean", F.greatest(F.col("mean") - z * sd, F.lit(0.0)).alias("lower"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, block_above: float = 0.5, z: float = 1.645) -> DataFrame:
    """Verdict on every page: that of its longest rule, else that of its host's reputation.

    The pages that a rule decides are the labelled outcomes (block: bad).  A host is
    blocked if the lower bound of its posterior exceeds ``block_above``.  An empty
    host has the reputation of the labelled pages at large.  Columns: page_id, host,
    path, rule, verdict, n_labelled, bad_mean, bad_lower.  Repeated rows and rows
    without an id keep one row each; a null url gives empty parts; other columns are
    not looked at.  A host of any share of the pages is joined by broadcast.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    hit = match_rules(F.col("host"), F.col("path"), rules)
    seen = parts.withColumn("hit", hit).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled"))
    counts = materialise(seen.groupBy("host").agg(F.count("ruled").alias("n"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad"), F.count("*").alias("pages")))
    found = host_reputation(counts.drop("pages"), z=z).select("host", F.col("n").alias("n_labelled"), F.col("mean").alias("bad_mean"), F.col("lower").alias("bad_lower"))
    judged = join_keys(seen, materialise(found.join(counts.select("host", "pages"), "host")), "host", "pages")
    verdict = F.coalesce("ruled", F.when(F.col("bad_lower") > block_above, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "n_labelled", F.round("bad_mean", 6).alias("bad_mean"), F.round("bad_lower", 6).alias("bad_lower"))


def oracle_sql(rules: Sequence[tuple[str, str, str]] = RULES, block_above: float = 0.5, z: float = 1.645) -> str:
    """The same rows in DuckDB SQL."""
    order = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1] + r[2]))
    fits = lambda value: " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN '{value(v, h + p)}'" for v, h, p in order)
    cte = f"""p AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT *, CASE {fits(lambda v, r: r)} END AS rule, CASE {fits(lambda v, r: v)} END AS ruled FROM u),
l5 AS (SELECT host, count(ruled) AS n, count(*) FILTER (ruled = 'block') AS bad, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS key FROM m GROUP BY host),
l4 AS (SELECT *, regexp_full_match(key, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}|\\[.*\\]') AS address, CASE WHEN array_to_string(string_split(key, '.')[-2:], '.') IN ({", ".join(f"'{x}'" for x in SECOND_LEVEL)}) THEN 2 ELSE 1 END AS deep FROM l5),
l3 AS (SELECT host, n, bad, CASE WHEN address THEN key ELSE array_to_string(string_split(key, '.')[-(deep + 1):], '.') END AS key2, CASE WHEN address THEN 'ip' ELSE array_to_string(string_split(key, '.')[-deep:], '.') END AS key1 FROM l4),
l2 AS (SELECT key2 AS key, key1 AS parent, sum(n) AS n, sum(bad) AS bad FROM l3 GROUP BY ALL),
l1 AS (SELECT parent AS key, 0 AS parent, sum(n) AS n, sum(bad) AS bad FROM l2 GROUP BY ALL),
q0 AS (SELECT 0 AS key, (sum(bad) + 1) / (sum(n) + 2)::DOUBLE AS mean FROM l1)"""
    for k, source in ((1, "l1"), (2, "l2"), (3, "(SELECT host AS key, key2 AS parent, n, bad FROM l3)")):
        cte += f""",
j{k} AS (SELECT c.*, q.mean AS prior FROM {source} c JOIN q{k - 1} q ON q.key = c.parent),
f{k} AS (SELECT sum(pow(bad - n * prior, 2) - n * prior * (1 - prior)) AS excess, sum(n * (n - 1) * prior * (1 - prior)) AS scale FROM j{k} WHERE n > 0),
s{k} AS (SELECT least(greatest(1 / CASE WHEN scale > 0 THEN greatest(excess / scale, 1e-9) ELSE 0.5::DOUBLE END - 1, 2.0), 200.0) AS strength FROM f{k}),
q{k} AS (SELECT key, n, (bad + strength * prior) / (n + strength) AS mean, n + strength AS weight FROM j{k}, s{k})"""
    return f"""WITH {cte},
h AS (SELECT key, n, mean, greatest(mean - {z} * sqrt(mean * (1 - mean) / (weight + 1)), 0.0::DOUBLE) AS low FROM q3)
SELECT m.page_id, m.host, m.path, m.rule, coalesce(m.ruled, CASE WHEN h.low > {block_above} THEN 'block' ELSE 'allow' END) AS verdict, h.n AS n_labelled, round(h.mean, 6) AS bad_mean, round(h.low, 6) AS bad_lower
FROM m JOIN h ON h.key = m.host
"""
