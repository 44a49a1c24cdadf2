"""URL filters: explicit rules, then empirical-Bayes host reputation, in built-in functions only.

Labelled page outcomes (good or not) are counted per host and shrunk through beta-binomial priors: the corpus is the prior of each suffix,
a suffix of its registered domains, a domain of its hosts. The strength of each prior comes from the data: how
much more the children of a level differ than binomial counts would (moment estimate of the intra-class correlation). A host is
blocked if even the upper posterior bound of its good share lies under the least share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, written

#: The least good share, and the posterior standard deviations of the bound.
LEAST_SHARE, DEVIATIONS = 0.5, 1.645
#: Bounds of the estimated correlation; at the upper one a prior is worth two outcomes, so that a single one never decides.
CORRELATION = (0.001, 1 / 3)

# Public suffixes of two labels, besides which the suffix is the last label.
DOUBLE_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")

# The rules of the registered query, (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lowered; path: then up to ? or #. Both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*DOUBLE_SUFFIXES), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label more."""
    return F.when(F.substring_index(host, ".", -2).isin(*DOUBLE_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path joined), and its verdict; nulls if none does. Of rules of one length that fit, the greatest as
    text wins, of equal rules the last one given."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _shrunk(child: DataFrame, parent: DataFrame | None, up: str | None, overall: float) -> DataFrame:
    """child (key, up.., good, n) with `mean`, the posterior mean, and `strength`, the posterior's pseudo-counts."""
    if parent is None:
        with_prior = child.withColumn("prior", F.lit(overall))
    else:
        with_prior = child.join(parent.select(F.col("key").alias(up), F.col("mean").alias("prior")), up)
    with_prior = written(with_prior)
    spread = F.col("prior") * (1 - F.col("prior"))
    deviation = F.col("good") - F.col("n") * F.col("prior")
    seen = with_prior.where("n > 0").agg(F.sum(deviation * deviation / F.col("n")).alias("s"), F.sum(spread).alias("v"), F.sum(spread * (F.col("n") - 1)).alias("w")).first()
    rho = (seen.s - seen.v) / seen.w if seen.w else 0.0
    rho = min(max(rho, CORRELATION[0]), CORRELATION[1])
    prior_weight = (1 - rho) / rho
    total = F.col("n") + F.lit(prior_weight)
    return with_prior.withColumn("mean", (F.col("good") + F.lit(prior_weight) * F.col("prior")) / total).withColumn("strength", total)


def reputations(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """(key, mean, strength) for each host of hosts (host), from outcomes (host, good 0/1)."""
    labelled = outcomes.groupBy("host").agg(F.sum(F.col("good").cast("long")).alias("good"), F.count("good").alias("n"))
    known = hosts.select("host").distinct().join(labelled, "host", "left")
    known = written(known.select(F.col("host").alias("key"), domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("n", F.lit(0)).alias("n")))
    sums = (F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = known.agg(*sums).first()
    overall = ((total.good or 0) + 1) / ((total.n or 0) + 2)
    suffixes = _shrunk(known.groupBy(F.col("suffix").alias("key")).agg(*sums), None, None, overall)
    domains = _shrunk(known.groupBy(F.col("domain").alias("key"), "suffix").agg(*sums), suffixes, "suffix", overall)
    return _shrunk(known, domains, "domain", overall).select("key", "mean", "strength")


def upper_bound(mean: Column, strength: Column, deviations: float = DEVIATIONS) -> Column:
    return mean + F.lit(deviations) * F.sqrt(mean * (1 - mean) / (strength + 1))


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url); outcomes are (host, good).

    A null url or one without :// has empty host and path, no rule, and the reputation of the empty host; hosts without outcomes have
    their domain's; without any outcome nothing is blocked but by rule. Outcomes with a null host or value count for nothing.
    Repeated rows are judged alike, an empty table gives no rows, other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = reputations(outcomes.where("host IS NOT NULL AND good IS NOT NULL"), parsed)
    bad = written(known.where(upper_bound(F.col("mean"), F.col("strength")) < least_share).select(F.col("key").alias("host"), F.lit("block").alias("method")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parsed.join(bad, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "method", F.lit("allow")).alias("verdict"))


#: The number that ends a page's path names the document whose labels are the page's outcome.
NUMBER = r"([0-9]{1,18})(\.html|/)?$"


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good): labelled pages; good means quality 1 and not toxic. A label without quality or toxicity gives none."""
    host, path = host_and_path(F.col("url"))
    numbered = pages.select(host.alias("host"), F.regexp_extract(path, NUMBER, 1).try_cast("bigint").alias("doc_id"))
    good = labels.select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0).alias("good"))
    return numbered.join(good, "doc_id").select("host", "good")
