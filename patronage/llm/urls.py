"""URL filter: fixed rules, and empirical-Bayes host reputation where no rule speaks.

Labelled outcomes of pages (bad or not) are counted per host, registered domain and
suffix. Going down that ladder, every level's rate is shrunk towards the level above
by a beta-binomial prior; the prior's strength is estimated from how far the groups
of a level differ beyond chance. A host is blocked if the lower bound of its
posterior rate of bad pages is above a threshold. So a host with few labels is judged
mostly by its domain, one without labels by its domain alone, by its suffix where the
domain has no label either, and by all labels where the suffix has none.

Built-in functions only. Outcomes are summed per host, stored, and the levels above are
summed from the hosts; pages are read for the verdicts alone. Only three strengths come
to the driver.

Null url, or one without ``://``: host and path are empty, no rule fits, verdict
allow. Urls are taken whole, however long. Repeated rows are judged alike. Outcomes with
a null page or verdict are left out; several outcomes of a page all count. Of rules that
fit the longest wins; none are equally long and fit the same url with other verdicts. A
bound at the threshold allows. No outcomes: nothing but the rules blocks. An empty table
of pages gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import staged

PORT_OR_USER = r"^[^@]*@|:[0-9]*$"
#: Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
THRESHOLD = 0.5
Z = 1.645
LEAST_OVERLAP, MOST_OVERLAP = 0.001, 0.999


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: Sequence[UrlRule], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda rule: (len(rule.text), rule.text)):  # the longest is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
                       ).otherwise(found)
    return found


def levels(host: Column) -> dict[str, Column]:
    """Registered domain and suffix of a host, without port and user."""
    name = F.regexp_replace(host, PORT_OR_USER, "")
    two = F.substring_index(name, ".", -2)
    wide = two.isin(*TWO_LABEL_SUFFIXES)
    return {"domain": F.when(wide, F.substring_index(name, ".", -3)).otherwise(two),
            "suffix": F.when(wide, two).otherwise(F.substring_index(name, ".", -1))}


def _strength(groups: DataFrame) -> float:
    """How many labels the prior of a level weighs, by the moments of its groups around their priors."""
    chance = F.col("n") * F.col("prior") * (1 - F.col("prior"))
    excess = (F.col("bad") - F.col("n") * F.col("prior")) ** 2 - chance
    row = groups.agg(F.sum(excess).alias("excess"), F.sum(chance * (F.col("n") - 1)).alias("room")).first()
    overlap = row["excess"] / row["room"] if row["room"] else LEAST_OVERLAP
    overlap = min(max(overlap, LEAST_OVERLAP), MOST_OVERLAP)
    return 1 / overlap - 1


def _shrunk(groups: DataFrame) -> tuple[DataFrame, float]:
    strength = _strength(groups)
    mean = (F.col("bad") + strength * F.col("prior")) / (F.col("n") + strength)
    return groups.withColumn("mean", mean), strength


class Reputation(NamedTuple):
    """Posterior of the share of bad pages, and its lower bound, per rung of the ladder.

    The bounds of domains, suffixes and of all are those of a host without labels.
    """

    hosts: DataFrame  # host, n, bad, mean, bound
    domains: DataFrame  # domain, mean, bound
    suffixes: DataFrame  # suffix, mean, bound
    overall: float


def reputation(outcomes: DataFrame, z: float = Z) -> Reputation:
    """What labelled pages, given as host and bad (0 or 1), say; ``z`` standard deviations below the mean is the bound."""
    counts = (outcomes.filter(F.col("bad").isNotNull()).groupBy("host")
              .agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")))
    hosts = staged(counts.select("*", *[column.alias(name) for name, column in levels(F.col("host")).items()]), "hosts")
    domains = staged(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = staged(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = whole["bad"] / whole["n"] if whole["n"] else 0.0

    suffixes, _ = _shrunk(suffixes.withColumn("prior", F.lit(overall)))
    domains, _ = _shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"))
    hosts, strength = _shrunk(hosts.join(domains.select("domain", "suffix", F.col("mean").alias("prior")),
                                         ["domain", "suffix"]))

    def bound(n: Column) -> Column:
        return (F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (n + strength + 1))).alias("bound")

    none = F.lit(0)
    return Reputation(staged(hosts.select("host", "n", "bad", "mean", bound(F.col("n"))), "reputation"),
                      domains.select("domain", "mean", bound(none)), suffixes.select("suffix", "mean", bound(none)),
                      overall - z * (overall * (1 - overall) / (strength + 1)) ** 0.5)


def judged(pages: DataFrame, page_id: str, url: str, outcomes: DataFrame, rules: Sequence[UrlRule],
           threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every page.

    ``outcomes`` has url and bad (0 or 1), a row per labelled page.
    """
    labelled = outcomes.select(host_of(F.col("url")).alias("host"), "bad").filter(F.col("host") != "")
    known = reputation(labelled, z)
    parsed = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"),
                          path_of(F.col(url)).alias("path"))
    ruled = parsed.select("*", longest_rule(rules, F.col("host"), F.col("path")).alias("_rule"),
                          *[column.alias(f"_{name}") for name, column in levels(F.col("host")).items()])
    # the nearest rung that has labels tells
    for name, rung in (("host", known.hosts), ("_domain", known.domains), ("_suffix", known.suffixes)):
        told = rung.select(F.col(name.removeprefix("_")).alias(name), F.col("bound").alias(f"{name}_bound"))
        ruled = ruled.join(told, name, "left")
    bound = F.coalesce("host_bound", "_domain_bound", "_suffix_bound", F.lit(known.overall))
    verdict = F.when((F.col("host") != "") & (bound > threshold), "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                        F.coalesce(F.col("_rule.verdict"), verdict).alias("verdict"))
