"""Operator 1, URL filters: rules on hosts and paths, and for the rest an empirical-Bayes host reputation.

All of it is DataFrame expressions. Labelled page outcomes are counted per host; host, registered domain and suffix
are levels of one hierarchy. Each level's rate is shrunk to its parent's: suffix to the corpus rate, domain to its
suffix, host to its domain. The strength of each beta prior comes from the data by moments (how far the children's
rates lie apart beyond binomial noise). A host without outcomes gets its domain's rate, or its suffix's, or the
corpus rate. It is blocked if the lower bound (mean - z * sd of its beta posterior) of its bad rate is above
``threshold``: only hosts known to be bad beyond doubt go.

Defined cases: a null url, or one without ``://``, has an empty host and path, and no labels count for it; hosts
without a dot are their own domain and suffix. Null outcomes count for nothing. Repeated pages repeat their result.
No outcomes at all: every page that no rule blocks is allowed. Columns other than id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (host/path, verdict); the longest that fits wins.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Suffixes of two labels under which domains are registered; other suffixes have one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
#: Lower posterior bound of the bad rate above which a host is blocked, standard deviations below the mean, and the
#: range of a prior's strength in pseudo-counts.
THRESHOLD, Z, LEAST_PRIOR, MOST_PRIOR = 0.5, 1.645, 1.0, 1000.0
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as its string; null if none does. A tie goes to the first in alphabetical order."""
    out = F.lit(None).cast("string")
    for rule in sorted((r for r, _ in rules), key=lambda r: (-len(r), r), reverse=True):
        own, _, under = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{under}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label before it."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _shrunk(level: DataFrame, mean: str) -> DataFrame:
    """level (n, k, and the parent's rate as mean) with rate and the beta posterior's a and b. The prior's strength is one
    number for the level, by moments over its nodes with outcomes: E[(k - n m)^2] = n m (1 - m) (1 + (n - 1) rho)."""
    m = F.col(mean)
    spare = F.sum(F.when(F.col("n") > 1, (F.col("k") - F.col("n") * m) ** 2 - F.col("n") * m * (1 - m)))
    scale = F.sum(F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1) * m * (1 - m)))
    rho = spare / F.when(scale > 0, scale)
    strength = level.agg(F.coalesce(F.least(F.greatest((1 - rho) / F.when(rho > 0, rho), F.lit(LEAST_PRIOR)), F.lit(MOST_PRIOR)), F.lit(MOST_PRIOR)).alias("s"))
    out = level.withColumn("s", strength.scalar())
    a, b = F.col("s") * m + F.col("k"), F.col("s") * (1 - m) + F.col("n") - F.col("k")
    return out.withColumn("a", a).withColumn("b", b).withColumn("rate", F.col("a") / (F.col("a") + F.col("b"))).drop("s")


def host_reputation(hosts: DataFrame) -> DataFrame:
    """hosts (host, n outcomes, k bad ones; one row a host) -> (host, n, k, mean, lower): posterior mean and bound of the bad rate."""
    named = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    sums = (F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = written(named.groupBy("suffix", "domain").agg(*sums), "domain-counts")
    suffixes = domains.groupBy("suffix").agg(*sums)
    # with a pseudo-outcome of each kind, so that no rate is 0 or 1
    corpus = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("root"))
    by_suffix = written(_shrunk(suffixes.withColumn("root", corpus.scalar()), "root").select("suffix", F.col("rate").alias("suffix_rate")), "suffixes")
    by_domain = written(_shrunk(domains.join(by_suffix, "suffix"), "suffix_rate").select("domain", F.col("rate").alias("domain_rate")), "domains")
    a, b = F.col("a"), F.col("b")
    return _shrunk(named.join(by_domain, "domain"), "domain_rate").select("host", "n", "k", F.col("rate").alias("mean"), (F.col("rate") - Z * F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))).alias("lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, mean, lower) of every page. outcomes: (id, bad 0/1), any number a page."""
    rules = RULES if rules is None else rules
    url = F.col(url_col)
    judged = pages.select(id_col, host_of(url).alias("host"), path_of(url).alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    seen = outcomes.select(id_col, F.col("bad").cast("long").alias("bad")).dropna().groupBy(id_col).agg(F.count("bad").alias("n"), F.sum("bad").alias("k"))
    # every host takes part, so the join below always finds its row; hosts are counted before they are shuffled
    counted = judged.select(id_col, "host").join(seen, id_col, "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    hosts = counted.withColumn("k", F.when(F.col("host") == "", 0).otherwise(F.col("k"))).withColumn("n", F.when(F.col("host") == "", 0).otherwise(F.col("n")))
    scored = host_reputation(written(hosts, "hosts"))  # a table of hosts, so that every level reads it and not the pages
    verdicts = F.create_map(*(F.lit(x) for r, v in rules for x in (r, v))) if rules else F.create_map().cast("map<string,string>")
    own = F.when(F.col("lower") > threshold, "block").otherwise("allow")
    return judged.join(scored.select("host", "mean", "lower"), "host", "left").select(id_col, "host", "path", "rule", F.coalesce(F.element_at(verdicts, F.col("rule")), own).alias("verdict"), "mean", "lower")
