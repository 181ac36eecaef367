"""URL filter: listed rules, and the reputation of hosts where no rule fits.

Reputation is an empirical-Bayes estimate. Labelled outcomes of pages (bad or
not) are counted per host, registered domain and suffix. Each level's rate is
shrunk towards the level above it through a beta prior whose strength is
estimated from the spread of the rates at that level (method of moments of the
beta-binomial). A host is blocked when the lower bound of its posterior rate of
bad pages exceeds a limit: ``max_bad``, or the rate whose odds are ``worse``
times those of all labelled pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.session import materialise

# Public suffixes of two labels; every other suffix is the last label.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr",
    "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Allow or block a host with all its subdomains, for paths with a prefix; ``pattern`` is host and path."""

    action: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


@dataclass(frozen=True)
class Reputation:
    """Settings of the posterior: quantile of its lower bound, the tolerated rate, and bounds of a prior's strength.

    Where no ``max_bad`` is given, the tolerated rate follows from the base rate
    by ``worse``, the tolerated multiple of its odds.
    """

    z: float = 1.645
    max_bad: float | None = None
    worse: float = 1.5
    least_strength: float = 1.0
    most_strength: float = 1000.0
    suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Pattern of the longest rule that fits (of equal ones: the longer host, then the first listed), else null."""
    cases = F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: (-len(r.pattern), -len(r.host)))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        cases = F.when(fits, F.lit(rule.pattern)).otherwise(cases)
    return cases


def site_levels(host: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without user part and port; an address is its own domain."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    last_two = F.regexp_extract(bare, r"([^.]+\.[^.]+)$", 1)
    suffix = F.when(last_two.isin(*suffixes), last_two).otherwise(F.regexp_extract(bare, r"([^.]*)$", 1))
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    suffix = F.when(address, F.lit("")).otherwise(suffix)
    labels = F.split(bare, r"\.")
    taken = F.when(last_two.isin(*suffixes), 3).otherwise(2)
    domain = F.when(address | (F.size(labels) <= taken), bare).otherwise(
        F.array_join(F.slice(labels, F.size(labels) - taken + 1, taken), ".")
    )
    return domain, suffix


def strength(children: DataFrame, settings: Reputation) -> float:
    """Strength of the beta prior of a level, from ``n``, ``x`` and the mean ``m`` above of every child.

    One pass of sums; the correlation of outcomes within a child is estimated by
    moments, kept in the settings' bounds. Without labelled children the prior
    is as strong as allowed. Sums are rounded, so their order cannot matter.
    """
    seen = children.filter("n > 0")
    noise = F.col("m") * (1 - F.col("m"))
    row = seen.filter(noise > 0).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.count("*").alias("k"),
        F.sum(F.col("n") * F.pow(F.col("x") / F.col("n") - F.col("m"), 2) / noise).alias("s"),
    ).first()
    if not row["k"] or row["k"] < 2:
        return settings.most_strength
    free = row["n"] - row["n2"] / row["n"] - (row["k"] - 1)
    within = (row["s"] - (row["k"] - 1)) / free if free > 0 else 0.0
    low, high = 1 / (1 + settings.most_strength), 1 / (1 + settings.least_strength)
    return round(1 / min(high, max(low, within)) - 1, 9)


def host_reputation(pages: DataFrame, outcomes: DataFrame, settings: Reputation = Reputation()) -> DataFrame:
    """One row per host: counts ``n``, ``bad``, the posterior ``mean`` and lower ``bound`` of its rate of bad pages, and the ``limit``.

    ``pages`` has ``page_id, host``, ``outcomes`` has ``page_id, bad`` (0 or 1;
    null outcomes are ignored, repeated ids count once, bad if any is). Hosts
    without a labelled page take the posterior of their domain.
    """
    known = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = (
        pages.join(known, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("x"))
    )
    domain, suffix = site_levels(F.col("host"), settings.suffixes)
    hosts = materialise(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    sums = F.sum("n").alias("n"), F.sum("x").alias("x")
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    total = domains.agg(*sums).first()
    top = (total["x"] + 0.5) / (total["n"] + 1) if total["n"] is not None else 0.5
    limit = settings.max_bad if settings.max_bad is not None else settings.worse * top / (1 + (settings.worse - 1) * top)

    def posterior(level: DataFrame, above: float) -> DataFrame:
        return level.withColumn("mean", (F.col("x") + F.lit(above) * F.col("m")) / (F.col("n") + F.lit(above)))

    suffixes = domains.groupBy("suffix").agg(*sums).withColumn("m", F.lit(top))
    suffixes = posterior(suffixes, strength(suffixes, settings)).select("suffix", F.col("mean").alias("m"))
    domains = materialise(domains.join(suffixes, "suffix"))
    domains = posterior(domains, strength(domains, settings)).select("domain", F.col("mean").alias("m"))
    hosts = materialise(hosts.join(domains, "domain"))
    above = strength(hosts, settings)
    hosts = posterior(hosts, above)
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(above) + 1))
    return hosts.select(
        "host", "domain", "suffix", "n", F.col("x").alias("bad"), "mean",
        F.greatest(F.lit(0.0), F.col("mean") - settings.z * deviation).alias("bound"),
        F.lit(limit).alias("limit"),
    )


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule],
    settings: Reputation = Reputation(),
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, n, bad, bound, limit`` of every page.

    The verdict is that of the longest fitting rule, else ``block`` if the
    host's posterior bound exceeds the limit and ``allow`` otherwise. A null
    url, or one without ``://``, has an empty host and path; rows with a null or
    repeated id are kept as they are. An empty table gives no rows. Other
    columns of the inputs are not read.
    """
    host, path = split_url(pages[url_col])
    split = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    split = split.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    reputation = host_reputation(split, outcomes, settings).select("host", "n", "bad", "bound", "limit")
    action = F.lit(None).cast("string")
    for rule in rules:
        action = F.when(F.col("rule") == rule.pattern, F.lit(rule.action)).otherwise(action)
    judged = F.when(F.col("bound") > F.col("limit"), "block").otherwise("allow")
    return split.join(reputation, "host").select(
        "page_id", "host", "path", "rule", F.coalesce(action, judged).alias("verdict"), "n", "bad", "bound", "limit"
    )
