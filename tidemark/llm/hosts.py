"""Empirical-Bayes host reputation as a URL filter.

Labelled page outcomes (1 = bad) are counted per host.  A beta-binomial prior
is fitted by moments at three levels - suffix under the whole web, registered
domain under its suffix, host under its domain - so a host with few labels is
shrunk to its domain, a small domain to its suffix and a small suffix to the
overall rate (itself with a weak prior of 1 bad page in 10).  A host is blocked
when the lower bound of its posterior bad rate (mean - z standard deviations)
is above ``worst`` times the overall rate: it is worse than the rest beyond
what its labels leave open.  Explicit rules come first: the longest rule that
fits a URL decides.

The evidence join is on the document a page was made from; the counts are
partial aggregates, so a host with a third of all pages costs one row per map
task.  Verdicts are one row per host, written and joined back: Spark broadcasts
that table when its measured size allows, and otherwise splits a hot host.

Edge cases: a null URL or one without ``://`` has empty host and path; the
empty host is a host like others, with itself as domain and suffix; repeated
labels of one document count once, as bad if any is bad; null labels count as
not bad; an empty label table leaves every host at the prior rate; repeated
pages are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, written

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The number of the source document at the end of a page's path.
PAGE_DOC = r"/([0-9]{1,18})(?:\.[a-z]+)?/?$"
#: Second-level labels that belong to the suffix when a two-letter label follows.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")

#: The rules of the query's contract: (action, rule).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))


@dataclass(frozen=True)
class Reputation:
    """``z``: width of the posterior bound; ``worst``: bad rate a host may
    have, as a multiple of the overall rate; ``least``/``most``: range of the
    fitted prior strength."""

    z: float = 1.645
    worst: float = 1.0
    least: float = 0.5
    most: float = 10000.0


def host_of(url: str) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def matching_rule(rules, host: str = "host", path: str = "path") -> Column:
    """The longest rule that fits: its host or a subdomain, and a path that
    starts with the rule's.  ``rules`` is a short list of the caller's."""
    fit = None
    for _, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        name, slash, rest = r.partition("/")
        hit = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith(slash + rest)
        fit = F.when(hit, r) if fit is None else fit.when(hit, r)
    return fit if fit is not None else F.lit(None).cast("string")


def with_levels(hosts: DataFrame) -> DataFrame:
    """host -> host, domain (registered domain), suffix."""
    labels = F.split(F.regexp_replace("host", r":[0-9]*$", ""), r"\.")
    n = F.size(labels)
    two = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(*SECOND_LEVEL)
    k = F.when(two, 2).otherwise(1)
    tail = lambda m: F.array_join(F.slice(labels, F.greatest(F.lit(1), n - m + 1), F.least(n, m)), ".")
    return hosts.withColumn("suffix", tail(k)).withColumn("domain", tail(k + 1))


def strength(groups: DataFrame, mean: str, cfg: Reputation) -> float:
    """Prior strength of a level from the spread of its groups (n, k) about
    their parents' means, by moments: one number of one aggregate row."""
    t = groups.where("n > 0").select(
        "n", (F.col("n") * (F.col("k") / F.col("n") - F.col(mean)) * (F.col("k") / F.col("n") - F.col(mean))).alias("s"),
        (F.col(mean) * (1 - F.col(mean))).alias("v"))
    t = t.agg(F.sum("s").alias("s"), F.sum("n").cast("double").alias("total"), F.sum(F.col("n") * F.col("n")).cast("double").alias("sq"),
              F.count("*").cast("double").alias("m"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v"))
    free = F.col("total") - F.col("sq") / F.col("total") - (F.col("m") - 1)
    rho = F.when((F.col("v") > 0) & (free > 0), (F.col("s") / F.col("v") - (F.col("m") - 1)) / free)
    k = F.when(rho > 0, 1 / rho - 1)
    return t.select(F.least(F.greatest(F.coalesce(k, F.lit(cfg.most)), F.lit(cfg.least)), F.lit(cfg.most))).first()[0]


def _shrunk(groups: DataFrame, prior: str, out: str, cfg: Reputation) -> DataFrame:
    """Adds the level's strength and the posterior mean ``out``."""
    g = groups.withColumn("strength", F.lit(strength(groups, prior, cfg)))
    return g.withColumn(out, (F.col("k") + F.col("strength") * F.col(prior)) / (F.col("n") + F.col("strength")))


def reputations(evidence: DataFrame, cfg: Reputation = Reputation()) -> DataFrame:
    """``evidence(host, n, k)`` (n labelled pages, k bad ones; repeats are
    summed) -> host, n, k, bad_mean, bad_lower, and the overall rate."""
    hosts = written(with_levels(evidence.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))), "host-counts")
    rate = hosts.agg((F.coalesce(F.sum("k"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 10.0)).first()[0]
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("rate", F.lit(rate))
    suffixes = written(_shrunk(suffixes, "rate", "suffix_rate", cfg).select("suffix", "suffix_rate"), "host-suffixes")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suffixes, "suffix")
    domains = written(_shrunk(domains, "suffix_rate", "domain_rate", cfg).select("domain", "suffix", "domain_rate"), "host-domains")
    h = _shrunk(hosts.join(domains, ["suffix", "domain"]), "domain_rate", "bad_mean", cfg)
    sd = F.sqrt(F.col("bad_mean") * (1 - F.col("bad_mean")) / (F.col("n") + F.col("strength") + 1))
    return h.select("host", "n", "k", "bad_mean", (F.col("bad_mean") - cfg.z * sd).alias("bad_lower"), F.lit(rate).alias("rate"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, cfg: Reputation = Reputation()) -> DataFrame:
    """``pages(page_id, url)`` and ``labels(doc_id, quality, toxic)`` ->
    page_id, host, path, rule, verdict, bad_lower (rounded to 6 places); one
    row per row of ``pages``."""
    p = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    outcome = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    made_of = F.regexp_extract("path", PAGE_DOC, 1)
    of = p.where(made_of != "").select("host", made_of.cast("long").alias("doc_id"))
    found = of.join(outcome, "doc_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    seen = p.select("host").distinct().select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"))
    r = written(reputations(seen.unionByName(found), cfg).select(F.col("host").alias("of"), "bad_lower", "rate"), "host-verdicts")
    actions = F.create_map(*(F.lit(x) for a, r_ in rules for x in (r_, a))) if rules else F.create_map().cast("map<string,string>")
    out = p.join(r, p.host == r.of).withColumn("rule", matching_rule(rules))
    by_method = F.when(F.col("bad_lower") > cfg.worst * F.col("rate"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce(F.element_at(actions, F.col("rule")), by_method).alias("verdict"),
                      F.round("bad_lower", 6).alias("bad_lower"))


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), o AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), f AS (
  SELECT host, CAST(regexp_extract(path, '/([0-9]{1,18})(\.[a-z]+)?/?$', 1) AS BIGINT) AS doc_id
  FROM p WHERE regexp_extract(path, '/([0-9]{1,18})(\.[a-z]+)?/?$', 1) <> ''
), e AS (
  SELECT p.host, coalesce(max(x.n), 0) AS n, coalesce(max(x.k), 0) AS k
  FROM p LEFT JOIN (SELECT host, count(*) AS n, sum(bad) AS k FROM f JOIN o USING (doc_id) GROUP BY host) x ON x.host = p.host GROUP BY p.host
), s AS (
  SELECT *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l,
         CASE WHEN len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS w FROM e
), h AS (
  SELECT host, n, k, array_to_string(l[greatest(1, len(l) - w + 1):], '.') AS suffix, array_to_string(l[greatest(1, len(l) - w):], '.') AS domain FROM s
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1.0) / (sum(n) + 10.0) FROM h) AS up FROM h GROUP BY suffix
), s1 AS (
  SELECT sum(n * (k / n - up) * (k / n - up)) AS s, sum(n) AS total, sum(n * n) AS sq, count(*) AS m, sum(n * up * (1 - up)) / sum(n) AS v FROM s0 WHERE n > 0
), s2 AS (
  SELECT CASE WHEN v > 0 AND total - sq / total - (m - 1) > 0 THEN (s / v - (m - 1)) / (total - sq / total - (m - 1)) END AS rho FROM s1
), s3 AS (
  SELECT suffix, (k + z * up) / (n + z) AS rate FROM s0, (SELECT least(greatest(coalesce(CASE WHEN rho > 0 THEN 1 / rho - 1 END, 10000), 0.5), 10000) AS z FROM s2)
), d0 AS (
  SELECT suffix, domain, sum(n) AS n, sum(k) AS k, max(rate) AS up FROM h JOIN s3 USING (suffix) GROUP BY suffix, domain
), d1 AS (
  SELECT sum(n * (k / n - up) * (k / n - up)) AS s, sum(n) AS total, sum(n * n) AS sq, count(*) AS m, sum(n * up * (1 - up)) / sum(n) AS v FROM d0 WHERE n > 0
), d2 AS (
  SELECT CASE WHEN v > 0 AND total - sq / total - (m - 1) > 0 THEN (s / v - (m - 1)) / (total - sq / total - (m - 1)) END AS rho FROM d1
), d3 AS (
  SELECT suffix, domain, (k + z * up) / (n + z) AS rate FROM d0, (SELECT least(greatest(coalesce(CASE WHEN rho > 0 THEN 1 / rho - 1 END, 10000), 0.5), 10000) AS z FROM d2)
), h0 AS (
  SELECT host, n, k, rate AS up FROM h JOIN d3 USING (suffix, domain)
), h1 AS (
  SELECT sum(n * (k / n - up) * (k / n - up)) AS s, sum(n) AS total, sum(n * n) AS sq, count(*) AS m, sum(n * up * (1 - up)) / sum(n) AS v FROM h0 WHERE n > 0
), h2 AS (
  SELECT CASE WHEN v > 0 AND total - sq / total - (m - 1) > 0 THEN (s / v - (m - 1)) / (total - sq / total - (m - 1)) END AS rho FROM h1
), h3 AS (
  SELECT host, (k + z * up) / (n + z) AS mean, n + z + 1 AS size FROM h0, (SELECT least(greatest(coalesce(CASE WHEN rho > 0 THEN 1 / rho - 1 END, 10000), 0.5), 10000) AS z FROM h2)
), b AS (
  SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / size) AS bad_lower FROM h3
), x AS (
  SELECT p.*, bad_lower,
         CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM p JOIN b USING (host)
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN bad_lower > (SELECT (sum(k) + 1.0) / (sum(n) + 10.0) FROM h) THEN 'block' ELSE 'allow' END AS verdict, round(bad_lower, 6) AS bad_lower
FROM x
"""
