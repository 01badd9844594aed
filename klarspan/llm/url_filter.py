"""URL filters by empirical-Bayes host reputation, with DataFrame functions alone.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. At each level a beta prior,
centred on the parent's posterior mean and as strong as the method of moments over the level's units makes it, shrinks
the level's rate. A host is blocked if the lower bound of its posterior (mean - z standard deviations) exceeds a
threshold. Written rules come before the method; among the rules that fit, the longest wins.

A url that is null or without `://` has an empty host and path, and such pages share the reputation of the empty host.
Outcomes that are null don't count; pages without labels take their parents' rate. Repeated rows each give a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klarspan.llm.decontaminate import LOWER, UPPER

#: Suffixes of two labels, under which domains are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "co.in", "co.kr", "com.mx", "co.za", "com.tr")
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@dataclass(frozen=True)
class Method:
    """Strengths are clamped to [least, most] pseudo-counts; z and threshold define the posterior bound."""

    least: float = 1.0
    most: float = 1000.0
    z: float = 1.645
    threshold: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    last2, last3 = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    two = last2.isin(*TWO_LABEL_SUFFIXES)
    return F.when(two, last2).otherwise(F.substring_index(host, ".", -1)), F.when(two, last3).otherwise(last2)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its action, null if none fits; equal lengths: the first given."""
    pattern = action = F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):
        of, start = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(start))
        pattern, action = F.when(fits, F.lit(text)).otherwise(pattern), F.when(fits, F.lit(act)).otherwise(action)
    return pattern, action


def _strength(level: DataFrame, m: Method) -> DataFrame:
    """One row: the prior's strength s by the method of moments over a level's units with n > 0 outcomes, k of them bad."""
    rate = F.col("k") / F.col("n")
    sums = level.where("n > 0").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("units"), F.sum(F.col("k") * rate).alias("kk"), F.sum(1 / F.col("n")).alias("inv"))
    p = F.col("k") / F.col("n")
    spread = F.col("kk") / F.col("n") - p * p
    within = p * (1 - p) * F.col("units") / F.col("n")
    s = F.when(spread > within, (p * (1 - p) - spread) / (spread - within)).otherwise(F.lit(m.most))
    return sums.select(F.coalesce(F.greatest(F.lit(m.least), F.least(F.lit(m.most), s)), F.lit(m.most)).alias("s"))


def reputation(pages: DataFrame, outcomes: DataFrame, method: Method = Method()) -> DataFrame:
    """host, n, k, mean, bound for every host of ``pages`` (page_id, url); outcomes: page_id, bad (0 or 1)."""
    host, _ = host_and_path(F.col("url"))
    known = outcomes.where("bad IS NOT NULL AND page_id IS NOT NULL").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    seen = pages.select("page_id", host.alias("host")).join(known, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).cast("double").alias("k"))
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = hosts.withColumn("suffix", suffix).withColumn("domain", domain)
    total = lambda by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    world, suffixes, domains = total([]), total(["suffix"]), total(["suffix", "domain"])
    mean = (F.col("k") + F.col("s") * F.col("above")) / (F.col("n") + F.col("s"))
    one = lambda df: F.broadcast(df)  # noqa: E731  a single row
    suffixes = suffixes.join(one(world.select((F.coalesce(F.col("k"), F.lit(0.0)) + 1).alias("k1"), (F.coalesce(F.col("n"), F.lit(0.0)) + 2).alias("n2"))), how="cross").join(one(_strength(suffixes, method)), how="cross")
    suffixes = suffixes.withColumn("above", F.col("k1") / F.col("n2")).select("suffix", mean.alias("above"))
    domains = domains.join(suffixes, "suffix").join(one(_strength(domains, method)), how="cross").select("domain", "suffix", mean.alias("above"))
    hosts = hosts.join(domains, ["domain", "suffix"]).join(one(_strength(hosts, method)), how="cross")
    weight = F.col("n") + F.col("s")
    return hosts.select("host", "n", "k", mean.alias("mean"), (mean - method.z * F.sqrt(mean * (1 - mean) / (weight + 1))).alias("bound"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules=RULES, method: Method = Method()) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    host, path = host_and_path(F.col("url"))
    pattern, action = rule_for(F.col("host"), F.col("path"), rules)
    judged = reputation(pages, outcomes, method).select("host", F.when(F.col("bound") > method.threshold, "block").otherwise("allow").alias("judged"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    return seen.join(judged, "host").select("page_id", "host", "path", pattern.alias("rule"), F.coalesce(action, "judged").alias("verdict"))


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Outcomes of the labels table: a page is bad if it is toxic or of low quality; a label's doc_id names the page."""
    return labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0).alias("bad"))


_M = Method()
_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
_STRENGTH = f"SELECT coalesce(greatest({_M.least}, least({_M.most}, CASE WHEN v > w THEN (p * (1 - p) - v) / (v - w) ELSE {_M.most} END)), {_M.most}) AS s FROM (SELECT sum(k) / sum(n) AS p, sum(k * (k / n)) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) AS v, (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) * count(*) / sum(n) AS w FROM {{}} WHERE n > 0)"
_FITS = [(act, text, f"((host = '{text[: text.index('/')]}' OR ends_with(host, '.{text[: text.index('/')]}')) AND starts_with(path, '{text[text.index('/') :]}'))") for act, text in sorted(RULES, key=lambda r: -len(r[1]))]
ORACLE = f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
page AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM named),
known AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS k FROM labels WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY 1),
seen AS (SELECT host, CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(k), 0) AS DOUBLE) AS k FROM page LEFT JOIN known USING (page_id) GROUP BY host),
hosts AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS last2, array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS last3, string_split(host, '.')[-1] AS last1 FROM seen),
host AS (SELECT host, n, k, CASE WHEN last2 IN ({_TWO}) THEN last2 ELSE last1 END AS suffix, CASE WHEN last2 IN ({_TWO}) THEN last3 ELSE last2 END AS domain FROM hosts),
suffix AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM host GROUP BY 1),
domain AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM host GROUP BY 1, 2),
world AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS above FROM host),
suffix2 AS (SELECT suffix, (k + s * above) / (n + s) AS above FROM suffix, world, ({_STRENGTH.format("suffix")})),
domain2 AS (SELECT d.domain, d.suffix, (d.k + s * above) / (d.n + s) AS above FROM domain d JOIN suffix2 USING (suffix), ({_STRENGTH.format("domain")})),
host2 AS (SELECT host, n + s AS weight, (k + s * above) / (n + s) AS mean FROM host JOIN domain2 USING (domain, suffix), ({_STRENGTH.format("host")})),
judged AS (SELECT host, CASE WHEN mean - {_M.z} * sqrt(mean * (1 - mean) / (weight + 1)) > {_M.threshold} THEN 'block' ELSE 'allow' END AS judged FROM host2)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {f} THEN '{text}'" for _, text, f in _FITS)} END AS rule, CASE {" ".join(f"WHEN {f} THEN '{act}'" for act, _, f in _FITS)} ELSE judged END AS verdict
FROM page JOIN judged USING (host)
"""
