"""URL filters: fixed rules first, then empirical-Bayes reputations of hosts.

A host's share of bad pages is estimated from labelled pages. Its prior is a beta distribution around
the estimate of its registered domain, whose prior is centred on its public suffix, whose prior is
centred on the whole. How strongly each level leans on the one above comes from how much the level's
groups differ (method of moments); where nothing tells, it leans as little as it may. What is unknown
about the levels above widens the posterior. A page is blocked where even the lower bound of its host's
posterior is above the accepted share. All of it is grouping and joining on the host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.llm.tables import cut_lineage

RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
# Second-level names under which hosts are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
MAX_BAD = 0.3  # accepted share of bad pages
Z = 1.645  # one-sided 95 % bound
STRENGTH = (1.0, 1000.0)  # least and most weight of a prior, in pages

RESULTS = ("host", "path", "rule", "bad_share", "bad_low", "verdict")


def url_host(url: F.Column) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(raw, upper, upper.lower())


def url_path(url: F.Column) -> F.Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: F.Column) -> F.Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def public_suffix(host: F.Column) -> F.Column:
    """The last label, or the last two under a country code with second-level registration."""
    second = "|".join(SECOND_LEVEL)
    two = F.regexp_extract(host, rf"(?:^|\.)((?:{second})\.[a-z]{{2}})$", 1)
    return F.when(two != "", two).otherwise(F.regexp_extract(host, r"([^.]*)$", 1))


def registered_domain(host: F.Column, suffix: F.Column) -> F.Column:
    """The suffix and the label before it (the host itself where there is none)."""
    rest = F.substring(host, F.lit(1), F.greatest(F.length(host) - F.length(suffix) - 1, F.lit(0)))
    label = F.regexp_extract(rest, r"([^.]*)$", 1)
    return F.when(label == "", host).otherwise(F.concat(label, F.lit("."), suffix))


def rule_for(host: F.Column, path: F.Column, rules: Sequence[tuple[str, str, str]]) -> F.Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, chosen).otherwise(out)
    return out


def longest_suffix(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(host, suffix): the longest of ``suffixes`` (suffix) that a host ends in, label by label.

    A host that ends in none has its last label. Every host is tried with each of its own endings, so
    the table may be of any size.
    """
    labels = F.split("host", r"\.")
    ending = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    tried = hosts.select("host", F.explode(ending).alias("_ending"))
    listed = suffixes.select(F.col("suffix").alias("_ending")).where("_ending is not null").distinct()
    found = tried.join(listed, "_ending").groupBy("host").agg(F.max_by("_ending", F.length("_ending")).alias("suffix"))
    last = F.regexp_extract(F.col("host"), r"([^.]*)$", 1)
    return hosts.select("host").join(found, "host", "left").select("host", F.coalesce("suffix", last).alias("suffix"))


def _shrink(level: DataFrame, prior: str, unsure: str, into: str) -> DataFrame:
    """Posterior mean ``into`` of each group's bad share around ``prior``, and its variance.

    Groups differ by sampling and by themselves; the excess of the observed spread over that of
    sampling gives the beta prior's strength (all groups' sums, one row, joined back). One group, or
    groups of one page each, tell nothing about it. ``unsure`` is the variance of the prior's mean.
    """
    expected = F.col(prior) * (1 - F.col(prior))
    off = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col(prior), 2)
    sums = level.where("n > 0").agg(
        F.sum(off).alias("spread"),
        F.sum(expected).alias("sampling"),
        F.sum((F.col("n") - 1) * expected).alias("room"),
        F.count(F.lit(1)).alias("groups"),
    )
    # E[spread] = sampling + room / (strength + 1)
    excess = F.col("spread") - F.col("sampling")
    told = (F.col("groups") > 1) & (F.col("room") > 0)
    strength = F.when(~told, STRENGTH[0]).when(excess > 0, F.col("room") / excess - 1).otherwise(STRENGTH[1])
    strength = F.least(F.greatest(strength, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))
    one = sums.select(F.coalesce(strength, F.lit(STRENGTH[0])).alias("_m"))
    weight = F.col("_m") + F.col("n")
    mean = (F.col(prior) * F.col("_m") + F.col("bad")) / weight
    # `one` is a single row
    level = level.crossJoin(F.broadcast(one)).withColumn(into, mean)
    own = F.col(into) * (1 - F.col(into)) / (weight + 1)
    return level.withColumn(f"{into}_var", own + F.pow(F.col("_m") / weight, 2) * F.col(unsure)).drop("_m")


def host_reputation(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """One row per host: labelled pages ``n``, ``bad``, posterior mean and lower bound of the share.

    ``outcomes`` has ``host``, ``n`` and ``bad`` (0 labelled pages where nothing is known); ``suffixes``
    (suffix) lists the public suffixes, else :func:`public_suffix` tells them.
    """
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    if suffixes is None:
        hosts = hosts.withColumn("suffix", public_suffix(F.col("host")))
    else:
        hosts = cut_lineage(hosts)
        hosts = hosts.join(longest_suffix(hosts, suffixes), "host")
    # every level is looked at twice: once for all groups' sums, once for each group
    hosts = cut_lineage(hosts.withColumn("domain", registered_domain(F.col("host"), F.col("suffix"))))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    sums = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    all_ = hosts.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
    all_ = all_.select(((F.col("b") + 0.5) / (F.col("t") + 1)).alias("p0"), "t")
    all_ = all_.select("p0", (F.col("p0") * (1 - F.col("p0")) / (F.col("t") + 2)).alias("p0_var"))
    sums = _shrink(sums.crossJoin(F.broadcast(all_)), "p0", "p0_var", "p1").select("suffix", "p1", "p1_var")
    domains = cut_lineage(domains.join(sums, "suffix"))
    domains = cut_lineage(_shrink(domains, "p1", "p1_var", "p2").select("domain", "p2", "p2_var"))
    hosts = _shrink(hosts.join(domains, "domain"), "p2", "p2_var", "p3")
    return hosts.select(
        "host",
        "n",
        "bad",
        F.col("p3").alias("bad_share"),
        F.greatest(F.col("p3") - Z * F.sqrt("p3_var"), F.lit(0.0)).alias("bad_low"),
    )


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    max_bad: float = MAX_BAD,
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """All pages with ``host``, ``path``, ``rule``, ``bad_share``, ``bad_low`` and ``verdict``.

    ``labels`` (doc_id, quality) mark pages by page_id; quality 0 is bad, null labels and ids are
    left out, and of several labels of a page the worst counts. A null url, or one without ``://``,
    has an empty host and path and is judged with all such pages. Repeated pages count once each.
    Rules win over the reputation, the longest first. Where nothing is known about a host and the levels
    above it, its page is allowed. ``suffixes`` (suffix) lists public suffixes; without it the last label
    counts, or the last two below a country code with second-level registration. Columns named like a result are replaced.
    """
    own = [F.col(f"`{c}`") for c in pages.columns if c not in RESULTS]
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").alias("_id"))
        .agg((F.min("quality") == 0).cast("long").alias("_bad"))
    )
    hosts = pages.select(F.col("page_id").alias("_id"), url_host(F.col("url")).alias("host"))
    outcomes = hosts.join(known, "_id", "left").groupBy("host").agg(
        F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad")
    )
    reputation = host_reputation(outcomes, suffixes).select(
        F.col("host").alias("_host"), "bad_share", "bad_low"
    )
    judged = pages.select(
        F.struct(*own).alias("_row"),
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
    )
    judged = judged.join(reputation, F.col("host") == F.col("_host"), "left").drop("_host")
    rule = rule_for(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bad_low") > max_bad, "block").otherwise("allow")
    return judged.select(
        "_row.*",
        "host",
        "path",
        rule["rule"].alias("rule"),
        "bad_share",
        "bad_low",
        F.coalesce(rule["verdict"], by_method).alias("verdict"),
    )


ORACLE = r"""
WITH raw AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM raw),
known AS (
  SELECT doc_id, CASE WHEN min(quality) = 0 THEN 1 ELSE 0 END AS bad
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
         CASE WHEN regexp_extract(host, '(?:^|\.)((?:ac|co|com|edu|gov|net|org)\.[a-z]{2})$', 1) <> ''
              THEN regexp_extract(host, '(?:^|\.)((?:ac|co|com|edu|gov|net|org)\.[a-z]{2})$', 1)
              ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix
  FROM split LEFT JOIN known ON page_id = doc_id GROUP BY host),
named AS (
  SELECT *, regexp_extract(substr(host, 1, greatest(length(host) - length(suffix) - 1, 0)), '([^.]*)$', 1) AS label
  FROM hosts),
placed AS (SELECT *, CASE WHEN label = '' THEN host ELSE label || '.' || suffix END AS domain FROM named),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM placed GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
all0 AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS p0, sum(n) AS t FROM suffixes),
all_ AS (SELECT p0, p0 * (1 - p0) / (t + 2) AS v0 FROM all0),
s0 AS (SELECT * FROM suffixes, all_),
m1 AS (SELECT CASE WHEN count(*) > 1 AND sum((n - 1) * p0 * (1 - p0)) > 0 THEN
                least(greatest(CASE WHEN sum(n * (bad / n - p0) * (bad / n - p0)) > sum(p0 * (1 - p0))
                THEN sum((n - 1) * p0 * (1 - p0)) / (sum(n * (bad / n - p0) * (bad / n - p0)) - sum(p0 * (1 - p0))) - 1
                ELSE 1000 END, 1), 1000) ELSE 1 END AS m FROM s0 WHERE n > 0),
s1 AS (SELECT suffix, m, n, v0, (p0 * m + bad) / (m + n) AS p1 FROM s0, m1),
s2 AS (SELECT suffix, p1, p1 * (1 - p1) / (m + n + 1) + (m / (m + n)) * (m / (m + n)) * v0 AS v1 FROM s1),
d0 AS (SELECT * FROM domains JOIN s2 USING (suffix)),
m2 AS (SELECT CASE WHEN count(*) > 1 AND sum((n - 1) * p1 * (1 - p1)) > 0 THEN
                least(greatest(CASE WHEN sum(n * (bad / n - p1) * (bad / n - p1)) > sum(p1 * (1 - p1))
                THEN sum((n - 1) * p1 * (1 - p1)) / (sum(n * (bad / n - p1) * (bad / n - p1)) - sum(p1 * (1 - p1))) - 1
                ELSE 1000 END, 1), 1000) ELSE 1 END AS m FROM d0 WHERE n > 0),
d1 AS (SELECT domain, m, n, v1, (p1 * m + bad) / (m + n) AS p2 FROM d0, m2),
d2 AS (SELECT domain, p2, p2 * (1 - p2) / (m + n + 1) + (m / (m + n)) * (m / (m + n)) * v1 AS v2 FROM d1),
h0 AS (SELECT * FROM placed JOIN d2 USING (domain)),
m3 AS (SELECT CASE WHEN count(*) > 1 AND sum((n - 1) * p2 * (1 - p2)) > 0 THEN
                least(greatest(CASE WHEN sum(n * (bad / n - p2) * (bad / n - p2)) > sum(p2 * (1 - p2))
                THEN sum((n - 1) * p2 * (1 - p2)) / (sum(n * (bad / n - p2) * (bad / n - p2)) - sum(p2 * (1 - p2))) - 1
                ELSE 1000 END, 1), 1000) ELSE 1 END AS m FROM h0 WHERE n > 0),
h1 AS (SELECT host, m, n, v2, (p2 * m + bad) / (m + n) AS p3 FROM h0, m3),
h2 AS (SELECT host, p3, p3 * (1 - p3) / (m + n + 1) + (m / (m + n)) * (m / (m + n)) * v2 AS v3 FROM h1),
judged AS (
  SELECT page_id, split.host, path,
         CASE WHEN (split.host = 'example.net' OR split.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (split.host = 'example.com' OR split.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (split.host = 'org' OR split.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (split.host = 'net' OR split.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
         p3 - 1.645 * sqrt(v3) AS low
  FROM split JOIN h2 ON split.host = h2.host)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
            WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN low > 0.3 THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
