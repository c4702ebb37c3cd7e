"""URL filtering: explicit host and path rules first, an empirical-Bayes host reputation for the rest.

Labelled page outcomes are summed by host (map-side combined, so a host with a third of all pages
sends a few rows) and stored once; registered domains and public suffixes are summed from there.  Each
level's beta-binomial strength comes from all its groups by the method of moments, and the
means are shrunk in a chain: corpus to suffix to registered domain to host.  A host passes if the lower
bound of its posterior stays at or above `least`.  All of it is DataFrame work; what comes to the driver
are five sums for each of the three levels.

For reputation, user names, ports and trailing dots are no part of a host.  An IP address is its own domain
and suffix, so that it borrows from the corpus alone.

Defined results: a null url, or one without ``://``, has an empty host and path; the empty host is a
host like any other; pages without a label count in no outcome; null or repeated page_id rows are
judged row by row (a label of a repeated page_id counts for each); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, joined_by_key, stored

#: Labels under which countries register names: with a country's two letters they are one suffix, such as ``co.uk``.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "go", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")


@dataclass(frozen=True)
class Rule:
    """verdict for urls of `place`: a host, a slash and a path prefix, such as ``example.com/en/``."""

    place: str
    verdict: str

    @property
    def fits(self) -> Column:
        host, _, path = self.place.partition("/")
        on_host = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        return on_host & F.col("path").startswith(f"/{path}")


def split_url(pages: DataFrame) -> DataFrame:
    """host and path columns; the host's A-Z lower-cased."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract("url", pattern, n), F.lit(""))
    return pages.withColumns({"host": ascii_lower(part(1)), "path": part(2)})


def bare_host(host: Column) -> Column:
    """A host without user name, port and trailing dots."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.+$", "")


def _is_address(host: Column) -> Column:
    return host.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")


def _two_labels(host: Column) -> Column:
    return host.rlike(rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$")


def registered_domain(host: Column) -> Column:
    """The public suffix and one label more, or all of a shorter host and of an address."""
    return F.when(_is_address(host), host).when(_two_labels(host), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def public_suffix(host: Column) -> Column:
    return F.when(_is_address(host), host).when(_two_labels(host), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def _moments(groups: DataFrame, level: str) -> DataFrame:
    """One row: the sums from which the prior strength among groups of (n, k) follows."""
    squares = F.sum(F.col("k") * F.col("k") / F.col("n")).alias("S")
    return groups.where("n > 0").agg(F.lit(level).alias("level"), F.sum("k").alias("K"), F.sum("n").alias("N"), F.count("*").alias("G"), squares)


def strength(row) -> float:
    """Pseudo-outcomes of a level's prior, by the method of moments.

    The share of the variance that lies between groups, kept within 0.001 and 0.5, gives a
    strength between 999 and 1.
    """
    if not row["N"]:
        return 1.0
    mu, sampled = row["K"] / row["N"], row["G"] / row["N"]
    within, share = mu * (1 - mu), 0.5
    if within > 0 and sampled < 1:
        share = (row["S"] / row["N"] - mu * mu - within * sampled) / (within * (1 - sampled))
    return 1 / max(0.001, min(0.5, share)) - 1


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, good) rows, good null where unlabelled, to one stored row a host with its posterior's bounds.

    Columns: host, n_rows, n, k, prior (the registered domain's shrunk mean), mean, lower, upper.
    """
    counts = [F.count("*").alias("n_rows"), F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("k")]
    hosts = outcomes.groupBy("host").agg(*counts).withColumn("bare", bare_host(F.col("host")))
    hosts = stored(hosts.withColumns({"domain": registered_domain(F.col("bare")), "suffix": public_suffix(F.col("bare"))}).drop("bare"), "url-hosts")
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = hosts.groupBy("suffix").agg(*sums)
    rows = {r["level"]: r for r in _moments(hosts, "host").union(_moments(domains, "domain")).union(_moments(suffixes, "suffix")).collect()}
    m = {level: strength(row) for level, row in rows.items()}
    p0 = ((rows["suffix"]["K"] or 0) + 1) / ((rows["suffix"]["N"] or 0) + 2)
    shrunk = lambda prior, level: (F.col("k") + m[level] * prior) / (F.col("n") + m[level])
    of_suffix = suffixes.select("suffix", shrunk(F.lit(p0), "suffix").alias("p_suffix"))
    of_domain = domains.join(of_suffix, "suffix").select("domain", "suffix", shrunk(F.col("p_suffix"), "domain").alias("prior"))
    judged = hosts.join(of_domain, ["domain", "suffix"]).withColumn("mean", shrunk(F.col("prior"), "host"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + m["host"] + 1))
    return stored(judged.select("host", "n_rows", "n", "k", "prior", "mean", (F.col("mean") - z * sd).alias("lower"), (F.col("mean") + z * sd).alias("upper")), "url-reputation")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], least: float = 0.5) -> DataFrame:
    """(page_id, url) and (page_id, good) to page_id, host, path, rule, verdict.

    rules is a literal list and becomes one CASE expression, longest place first.
    """
    places = split_url(pages.select("page_id", "url"))
    of_page = labels.select("page_id", "good").where("page_id IS NOT NULL")
    hosts = places.select("page_id", "host")
    # Null ids meet no label, and so need not meet each other either.
    labelled = hosts.where("page_id IS NOT NULL").join(of_page, "page_id", "left").select("host", "good")
    reputation = host_reputation(labelled.union(hosts.where("page_id IS NULL").select("host", F.lit(None).cast("boolean"))))
    first = F.coalesce(
        *(F.when(r.fits, F.struct(F.lit(r.place).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in sorted(rules, key=lambda r: (-len(r.place), r.place))),
        F.lit(None).cast("struct<rule:string,verdict:string>"),
    )
    by_reputation = F.when(F.col("lower") >= least, "allow").otherwise("block")
    ruled = joined_by_key(places.withColumn("_rule", first), reputation.select("host", "lower", "n_rows"), "host", "n_rows")
    return ruled.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", by_reputation).alias("verdict"))
