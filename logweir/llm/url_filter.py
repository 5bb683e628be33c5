"""URL filtering by explicit rules, then by the empirical-Bayes reputation of hosts.

Labelled pages are good or bad. A host's rate of good pages is shrunk towards its
registered domain's, that towards its suffix's, and that towards the overall rate. Each
step is a beta-binomial: the prior's mean is the parent's posterior mean, its
strength comes from the spread of the children's rates around their parents, by the method
of moments over all children of that level. A page is let through if the lower
posterior bound of its host reaches the threshold. Everything is grouped sums
and equi-joins on tables of hosts, domains and suffixes; page bodies aren't read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch, Sealed

#: Two-label suffixes under which names are registered; a parameter, not a full list: read_suffixes takes one from a file.
SECOND_LEVEL = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
THRESHOLD, Z = 0.5, 1.645
LEAST_RHO, MOST_RHO, ASSUMED_RHO = 0.001, 0.9, 0.1
OWN = ("host", "path", "rule", "verdict", "labelled", "good", "bound")


def _after_scheme(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(_after_scheme(url, 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return _after_scheme(url, 2)


def read_suffixes(path: str) -> tuple[str, ...]:
    """The two-label suffixes of a file in the public suffix list's format: one rule a line, // begins a remark, wildcards and exceptions are left out."""
    with open(path, encoding="utf-8") as f:
        rules = [line.strip() for line in f]
    return tuple(sorted({r for r in rules if r.count(".") == 1 and r[0] not in "*!/"}))


def suffix_of(host: Column, second_level: Sequence[str] = SECOND_LEVEL) -> Column:
    """The last label, or the last two where they are a listed suffix; an address of digits has none."""
    two, one = F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)
    return F.when(one.rlike(r"^[0-9]*$"), "").when(two.isin(*second_level), two).otherwise(one)


def domain_of(host: Column, second_level: Sequence[str] = SECOND_LEVEL) -> Column:
    """The suffix with one more label; an address of digits as it is."""
    suffix = suffix_of(host, second_level)
    labels = F.size(F.split(suffix, r"\."))
    return F.when(suffix == "", host).otherwise(F.array_join(F.slice(F.split(host, r"\."), -F.least(F.size(F.split(host, r"\.")), labels + 1), F.lit(99)), "."))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of the rules (verdict, 'host/path') that fits, and its verdict; nulls if none does. rules are a list in the driver."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):  # later ones go outside, so the longest is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _rho(table: DataFrame) -> float:
    """Correlation of outcomes within a child, from n, k and the parent's mean m: the excess spread over a binomial's."""
    spread = F.col("n") * F.col("m") * (1 - F.col("m"))
    row = table.where("n > 0").agg(F.sum((F.col("k") - F.col("n") * F.col("m")) ** 2 - spread).alias("over"), F.sum(spread * (F.col("n") - 1)).alias("most")).first()
    if not row.most:
        return ASSUMED_RHO
    return min(MOST_RHO, max(LEAST_RHO, row.over / row.most))


def _posterior(table: DataFrame, rho: float) -> tuple[Column, Column]:
    """a and b of the beta posterior."""
    strength = F.lit(1 / rho - 1)
    return strength * F.col("m") + F.col("k"), strength * (1 - F.col("m")) + F.col("n") - F.col("k")


def reputations(hosts: DataFrame, scratch: Scratch, second_level: Sequence[str] = SECOND_LEVEL, z: float = Z) -> DataFrame:
    """hosts (host, n, k): labelled and good pages of each, to the same with bound, the lower posterior bound of its rate."""
    table = scratch.keep(hosts.withColumn("domain", domain_of(F.col("host"), second_level)).withColumn("suffix", suffix_of(F.col("host"), second_level)))
    whole = table.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    suffixes = scratch.keep(table.groupBy("suffix").agg(*sums).withColumn("m", F.lit(((whole.k or 0) + 0.5) / ((whole.n or 0) + 1))))
    a, b = _posterior(suffixes, _rho(suffixes))
    means = suffixes.select(F.col("suffix").alias("parent"), (a / (a + b)).alias("m"))
    domains = table.groupBy("domain", "suffix").agg(*sums)
    domains = scratch.keep(domains.join(means, domains.suffix == means.parent).select("domain", "n", "k", "m"))
    a, b = _posterior(domains, _rho(domains))
    means = domains.select(F.col("domain").alias("parent"), (a / (a + b)).alias("m"))
    told = scratch.keep(table.join(means, table.domain == means.parent).select("host", "n", "k", "m"))
    a, b = _posterior(told, _rho(told))
    whole_ab = a + b
    return scratch.keep(told.select("host", "n", "k", (a / whole_ab - z * F.sqrt(a * b / (whole_ab * whole_ab * (whole_ab + 1)))).alias("bound")))


def url_filter(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), id_col: str = "page_id", url_col: str = "url",
    threshold: float = THRESHOLD, second_level: Sequence[str] = SECOND_LEVEL, z: float = Z,
) -> DataFrame:
    """pages with host, path, rule, verdict, labelled, good and bound. outcomes: (id, n, k), labels and good ones of a page.

    A url that is null or lacks :// has the empty host, which is judged like any other host.
    Outcomes of one id are added up; a page told twice counts once per host, and a null id
    matches no outcome. Hosts without outcomes are judged by their domain, suffix
    or the overall rate. Columns named like the added ones are replaced.
    """
    scratch, sealed = Scratch(pages.sparkSession, "urls"), Sealed(pages, *OWN)
    url = F.col(sealed[url_col])
    keyed = sealed.rows.select(F.col(sealed[id_col]).alias("id"), host_of(url).alias("host"))
    labelled = outcomes.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # the few labels meet their pages first; of the others only the hosts are told apart
    known = keyed.join(labelled, "id").distinct().groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    found = keyed.select("host").distinct().join(known, "host", "left").select("host", *(F.coalesce(c, F.lit(0)).alias(c) for c in "nk"))
    told = reputations(found, scratch, second_level, z)
    told = told.select(F.col("host").alias("key"), F.col("n").alias("labelled"), F.col("k").alias("good"), "bound")
    rows = sealed.rows.withColumns({"host": host_of(url), "path": path_of(url)})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_bound = F.when(F.col("bound") >= threshold, "allow").otherwise("block")
    return rows.join(told, F.col("host") == F.col("key")).select(
        *sealed.restored(), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_bound).alias("verdict"), "labelled", "good", "bound"
    )
