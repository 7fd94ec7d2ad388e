"""Operator 9: URL filters by rules, and by empirical-Bayes host reputation where no rule fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup_join, lower_az

#: (action, host, path) of the production rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Suffixes of two labels under which names are registered; elsewhere the suffix is the last label.
SUFFIXES = tuple(
    f"{second}.{country}"
    for country, seconds in {
        "uk": "co org me ltd plc net sch ac gov nhs police", "au": "com net org edu gov asn id", "nz": "co net org school ac govt geek", "za": "co org net web gov ac",
        "jp": "co ne or go ac ad ed gr lg", "kr": "co ne or re pe go ac", "in": "co net org firm gen ind ac edu gov", "cn": "com net org gov edu ac", "hk": "com net org edu gov idv", "tw": "com net org edu gov idv",
        "sg": "com net org edu gov per", "my": "com net org edu gov", "th": "co in ac go or net", "id": "co or web ac sch go", "il": "co org net ac gov muni", "tr": "com net org edu gov bel gen", "br": "com net org gov edu art blog",
        "ar": "com net org gob edu", "mx": "com net org gob edu", "co": "com net org gov edu nom", "pe": "com net org gob edu", "ua": "com net org edu gov in", "pl": "com net org edu gov waw", "at": "co or ac gv", "es": "com nom org gob edu",
    }.items()
    for second in seconds.split()
)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return lower_az(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _first_fitting(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], value: int) -> Column:
    """The longest rule that fits (of equals the one with the longer host): its action (0) or its text (1)."""
    found = F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.lit((action, h + p)[value])).otherwise(found)
    return found


def name_levels(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without its port: the suffix and one label more, and the last label, or two
    where those are one of `suffixes`."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    listed = two.isin(list(suffixes))
    return F.when(listed, F.substring_index(name, ".", -3)).otherwise(two), F.when(listed, two).otherwise(F.substring_index(name, ".", -1))


def shrinkage(groups: DataFrame, key: str) -> Column:
    """Prior strength of a level by moments: 1/rho - 1 for the intra-class correlation rho of (n, bad) by key."""
    n, b = F.col("n").cast("double"), F.col("bad").cast("double")
    s = groups.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(b).alias("b"), F.sum(n * n).alias("nn"), F.sum(b * b / n).alias("bb"))
    k, n, b, nn, bb = (F.col(c).cast("double") for c in ("k", "n", "b", "nn", "bb"))
    between = (bb - b * b / n) / (k - 1)
    within = (b - bb) / (n - k)
    n0 = (n - nn / n) / (k - 1)
    rho = (between - within) / (between + (n0 - 1) * within)
    rho = F.when((k > 1) & (n > k) & (between + (n0 - 1) * within > 0), F.greatest(F.lit(0.001), F.least(F.lit(0.999), rho))).otherwise(F.lit(0.1))
    return F.lit(float(s.select((1 / rho - 1).alias("v")).first().v))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, bad 0/1, null unlabelled, one row a page) -> host, mean and sd of the posterior share of bad pages.

    A host's outcomes are shrunk to its registered domain's, those to its suffix's, those to all. Each level's prior is
    Beta(strength * mean above, strength * (1 - mean above)), the strength by moments of that level. A host without
    labelled pages has the prior of its nearest level that has some: its domain, else its suffix, else all, with the
    strength that a host's prior has. Counts shrink to one row a host before anything else is done with them. No
    labelled pages: no rows.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    domain, suffix = name_levels(F.col("host"))
    hosts = cut(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    labelled = hosts.where("n > 0")
    if labelled.isEmpty():
        return labelled.select("host", "domain", "suffix", F.lit(0.0).alias("mean"), F.lit(0.0).alias("sd"))
    domains = cut(labelled.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg((F.sum("bad") / F.sum("n")).alias("m")).first().m
    ks, kd, kh = shrinkage(suffixes, "suffix"), shrinkage(domains, "domain"), shrinkage(labelled, "host")
    suffixes = cut(suffixes.select("suffix", ((F.col("bad") + ks * F.lit(total)) / (F.col("n") + ks)).alias("up")))
    domains = lookup_join(domains, suffixes, ["suffix"], F.xxhash64("domain")).select("domain", ((F.col("bad") + kd * F.col("up")) / (F.col("n") + kd)).alias("up"))
    hosts = lookup_join(hosts, domains, ["domain"], F.xxhash64("host"))
    hosts = lookup_join(hosts, suffixes.withColumnRenamed("up", "above"), ["suffix"], F.xxhash64("host"))
    up = F.coalesce("up", "above", F.lit(total))
    a, b = kh * up + F.col("bad"), kh * (1 - up) + F.col("n") - F.col("bad")
    return hosts.select("host", "domain", "suffix", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, bad: Column | None = None, z: float = 1.645, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    Where a rule fits, the longest decides. Elsewhere the reputation does: a host is blocked if the lower bound
    mean - z * sd of its posterior share of bad pages is above `threshold`, which for a host without labelled pages
    is its domain's, suffix's or all pages' prior; without any labelled page all are allowed. `bad` labels pages (1 bad,
    0 good, null unlabelled); by default the rules' own verdicts do.

    A null url or one without `://` has an empty host and path; the empty host is a host like any other. Urls are parsed
    whole. Null or repeated ids are kept, a row each; other columns may have any names. No pages: no rows.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), *([bad.cast("int").alias("bad")] if bad is not None else []))
    parsed = parsed.select("*", _first_fitting(F.col("host"), F.col("path"), rules, 1).alias("rule"), _first_fitting(F.col("host"), F.col("path"), rules, 0).alias("action"))
    label = F.col("bad") if bad is not None else F.when(F.col("action") == "block", 1).when(F.col("action") == "allow", 0)
    known = host_reputation(parsed.select("host", label.alias("bad")))
    blocked = known.where(F.col("mean") - z * F.col("sd") > threshold).select("host", F.lit("block").alias("judged"))
    rows = lookup_join(parsed, cut(blocked), ["host"], F.xxhash64("page_id"))
    verdict = F.coalesce("action", "judged", F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


QUERY = {"op9_filter_urls": lambda spark, sf_dir: filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))}


def _k(level: str) -> str:
    return f"""(SELECT 1 / (CASE WHEN k > 1 AND n > k AND bt + (n0 - 1) * wi > 0 THEN greatest(0.001::DOUBLE, least(0.999::DOUBLE, (bt - wi) / (bt + (n0 - 1) * wi))) ELSE 0.1::DOUBLE END) - 1
  FROM (SELECT k, n, (bb - b * b / n) / (k - 1) AS bt, (b - bb) / nullif(n - k, 0) AS wi, (n - nn / n) / (k - 1) AS n0
    FROM (SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS b, sum(n::DOUBLE * n) AS nn, sum(bad::DOUBLE * bad / n) AS bb FROM {level})))"""


ORACLE = {
    "op9_filter_urls": rf"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM parsed),
acted AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS action FROM ruled),
counted AS (SELECT host, count(action) AS n, count(*) FILTER (WHERE action = 'block') AS bad, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS labels FROM acted GROUP BY host),
two AS (SELECT *, array_to_string(labels[-2:], '.') IN ({", ".join(f"'{s}'" for s in SUFFIXES)}) AS listed FROM counted),
every AS (SELECT host, n, bad, array_to_string(CASE WHEN listed THEN labels[-3:] ELSE labels[-2:] END, '.') AS domain, array_to_string(CASE WHEN listed THEN labels[-2:] ELSE labels[-1:] END, '.') AS suffix FROM two),
hosts AS (SELECT * FROM every WHERE n > 0),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
ks AS (SELECT {_k("suffixes")} AS ks, {_k("domains")} AS kd, {_k("hosts")} AS kh, (SELECT sum(bad)::DOUBLE / sum(n) FROM suffixes) AS m),
s AS (SELECT suffix, (bad + ks * m) / (n + ks) AS up FROM suffixes, ks),
d AS (SELECT domain, (bad + kd * up) / (n + kd) AS up FROM domains JOIN s USING (suffix), ks),
above AS (SELECT host, n, bad, kh, coalesce(d.up, s.up, m) AS up FROM every LEFT JOIN d USING (domain) LEFT JOIN s ON s.suffix = every.suffix CROSS JOIN ks),
h AS (SELECT host, kh * up + bad AS a, kh * (1 - up) + n - bad AS b FROM above),
bounds AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM h)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM acted LEFT JOIN bounds USING (host)
"""
}
