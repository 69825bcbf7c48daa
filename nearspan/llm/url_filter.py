"""URL filters by empirical-Bayes host reputation, with DataFrame functions only.

Labelled outcomes of pages are summed by host, registered domain and suffix. At
each level a beta-binomial prior is centred at the level above (the suffix at
the whole); its strength is the most probable one of a grid, by the likelihood
of the level's groups and a prior that is flat in the share by which a group of
one label is shrunk. A host's share of bad pages is shrunk towards its domain's,
and that towards the suffix's. A host is blocked if the lower quantile of its
posterior is above the share of all labelled pages: if it is worse than the
whole with a probability of ``CONFIDENCE`` or more. Explicit rules come first;
the longest that fits wins.

Null URLs and those without ``://`` have an empty host and path and share one
reputation. A host's port is part of it, but not of its domain. Labels that are
null, or of no page, are not used; several labels of a page count as one, the
worst. Repeated pages count and pass through each; without labels nothing is
blocked but by rules; empty tables give empty results. Only the named columns
are read, so others may have any name. Sums are partial before each exchange, so
a host with many pages costs a row for each task, not for each page.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = "ac.uk co.jp co.kr co.nz co.uk co.za com.au com.br com.cn com.mx gov.uk net.au org.au org.uk".split()
#: Strengths that a prior may have, in pages; posterior probability from which a
#: host is blocked, and the normal deviate of that probability.
STRENGTHS = [2.0**k for k in range(1, 11)]
CONFIDENCE, DEVIATE = 0.75, 0.6744897501960817


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _labels(host: Column, suffixes: list[str]) -> tuple[Column, Column, Column, Column]:
    """Last one, two and three labels of a host without its port, and whether two are a suffix."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    one, two, three = (F.substring_index(name, ".", -k) for k in (1, 2, 3))
    return one, two, three, two.isin(suffixes)


def suffix_of(host: Column, suffixes: list[str] = TWO_LABEL_SUFFIXES) -> Column:
    one, two, _, listed = _labels(host, suffixes)
    return F.when(listed, two).otherwise(one)


def domain_of(host: Column, suffixes: list[str] = TWO_LABEL_SUFFIXES) -> Column:
    _, two, three, listed = _labels(host, suffixes)
    return F.when(listed, three).otherwise(two)


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    own, slash, rest = rule.partition("/")
    at_host = (host == own) | F.endswith(host, F.lit("." + own))
    return at_host & F.startswith(path, F.lit(slash + rest)) if slash else at_host


def rule_columns(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls. rules: verdict, rule."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule = F.coalesce(*(F.when(rule_fits(r, host, path), F.lit(r)) for _, r in ordered), F.lit(None).cast("string"))
    verdict = F.coalesce(*(F.when(rule_fits(r, host, path), F.lit(v)) for v, r in ordered), F.lit(None).cast("string"))
    return rule, verdict


def _log_gamma(x: Column) -> Column:
    """By Stirling's series, six steps up, to about nine digits."""
    up = x + 6
    steps = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    return (up - 0.5) * F.ln(up) - up + 0.9189385332046727 + 1 / (12 * up) - 1 / (360 * up * up * up) - F.ln(steps)


def _strength(groups: DataFrame, mean: Column) -> float:
    """The most probable strength of a level's prior; a sum for each comes back."""
    n, bad, s = F.col("n"), F.col("bad"), F.col("_s")
    parts = [(s * F.col("_mean"), bad, 1), (s * (1 - F.col("_mean")), n - bad, 1), (s, n, -1)]
    log_likelihood = sum((sign * (_log_gamma(a + k) - _log_gamma(a)) for a, k, sign in parts), F.lit(0.0))
    # a row for each strength, so that the expression is one
    each = groups.where(n > 0).select("n", "bad", mean.alias("_mean"), F.explode(F.array(*map(F.lit, STRENGTHS))).alias("_s"))
    sums = {r["_s"]: r["w"] for r in each.groupBy("_s").agg(F.sum(log_likelihood).alias("w")).collect()}
    # on a grid of equal ratios, flat in 1 / (1 + s)
    return max(STRENGTHS, key=lambda x: sums.get(x, 0.0) + math.log(x) - 2 * math.log1p(x))


def _shrunk(mean: Column, strength: float) -> Column:
    return (F.col("bad") + strength * mean) / (F.col("n") + strength)


def lower_quantile(good_side: Column, bad_side: Column) -> Column:
    """The quantile of a beta distribution (of the share of bad ones) that lies
    below with a probability of 1 - ``CONFIDENCE``: Paulson's approximation of
    the F distribution, solved for the value. It needs half a page on the good
    side, which a host that has less is given."""
    a, b = bad_side, F.greatest(F.lit(0.5), good_side)
    u, v = 1 / (9 * b), 1 / (9 * a)
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - u) * (1 - u) * v + (1 - v) * (1 - v) * u - DEVIATE * DEVIATE * u * v))
    under = (1 - u) * (1 - u) - DEVIATE * DEVIATE * u
    y = F.when(under > 0, F.greatest(F.lit(0.0), ((1 - u) * (1 - v) - DEVIATE * root) / under)).otherwise(F.lit(0.0))
    ratio = a * y * y * y
    return ratio / (b + ratio)


def host_reputation(pages: DataFrame, outcomes: DataFrame, suffixes: list[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``(host, n, bad, posterior, bound, overall)`` of every host: labelled
    pages, bad ones, mean and lower quantile of the posterior, and the share of
    all. pages: page_id, host; outcomes: page_id, bad (boolean, null: not labelled)."""
    labelled = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    hosts = (
        pages.select("page_id", "host").join(labelled, "page_id", "left")
        .groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    )
    hosts = materialize(hosts, "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    total = hosts.agg(*sums).first()
    overall = F.lit((total["bad"] + 1) / (total["n"] + 2)) if total["n"] else F.lit(0.5)
    by_suffix = hosts.groupBy("suffix").agg(*sums)
    means = by_suffix.select("suffix", _shrunk(overall, _strength(by_suffix, overall)).alias("suffix_mean"))
    by_domain = hosts.groupBy("domain", "suffix").agg(*sums).join(means, "suffix")
    means = by_domain.select("domain", "suffix", _shrunk(F.col("suffix_mean"), _strength(by_domain, F.col("suffix_mean"))).alias("domain_mean"))
    hosts = hosts.join(means, ["domain", "suffix"])
    strength = _strength(hosts, F.col("domain_mean"))
    mean, size = _shrunk(F.col("domain_mean"), strength), F.col("n") + strength
    return hosts.select("host", "n", "bad", mean.alias("posterior"), lower_quantile(size * (1 - mean), size * mean).alias("bound"), overall.alias("overall"))


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    suffixes: list[str] = TWO_LABEL_SUFFIXES,
    threshold: float | None = None,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``.
    suffixes: public suffixes of two labels. threshold: the share that a host's
    lower quantile must exceed to be blocked, if not that of all labelled pages."""
    url = F.col(f"`{url_col}`")
    parts = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    limit = F.col("overall") if threshold is None else F.lit(threshold)
    blocked = host_reputation(parts, outcomes, suffixes).where((F.col("n") > 0) & (F.col("bound") > limit)).select("host", F.lit("block").alias("by_host"))
    rule, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    return parts.join(blocked, "host", "left").select(F.col("page_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("by_host"), F.lit("allow")).alias("verdict"))
