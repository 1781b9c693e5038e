"""Hosts that many companies share, and sites under a table of listed domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadweave.functions.name import name_key
from leadweave.functions.url import site_key
from leadweave.operators.skew import skew_join
from leadweave.session import settle

# Hosts that the sketch follows at a time; it errs by less than a thousandth of the links at most.
TRACKED = 10_000


def host_degrees(sightings: DataFrame, least_share: float = 0.001, legacy_hosts: bool = False, tracked: int = TRACKED) -> DataFrame:
    """``host, n_links, n_names``: the hosts that at least *least_share* of all websites are on.

    A sketch of frequent items, merged from one per task, proposes *tracked* hosts at most; only those are counted
    exactly, by sightings and by different company names. A host of many names is a directory or a social network, not a
    company's site; give it to ``ignore_hosts``. With the default a host of that share is always among those proposed.
    """
    linked = settle(sightings.select(
        site_key(F.col("website"), legacy_hosts).alias("host"), F.nullif(name_key(F.col("company_name")), F.lit("")).alias("name")
    ).where("host is not null"))
    sketch = F.call_function("approx_top_k", F.col("host"), F.lit(tracked), F.lit(tracked))
    proposed = settle(linked.agg(sketch.alias("top"), F.count("*").alias("n_all")).select("n_all", F.inline("top").alias("host", "about")))
    # One row per host and name meets in the second count, so a hot host is summed up before it is gathered.
    pairs = linked.join(proposed.select("host"), "host", "left_semi").groupBy("host", "name").agg(F.count("*").alias("n"))
    degrees = pairs.groupBy("host").agg(F.sum("n").alias("n_links"), F.count("name").alias("n_names"))
    kept = degrees.join(proposed.select("host", "n_all"), "host").where(F.col("n_links") >= F.lit(least_share) * F.col("n_all"))
    return kept.select("host", "n_links", "n_names")


def shared_hosts(sightings: DataFrame, least_names: int, least_share: float = 0.001, legacy_hosts: bool = False) -> list[str]:
    """The hosts of :func:`host_degrees` with that many company names; at most ``TRACKED`` of them."""
    found = host_degrees(sightings, least_share, legacy_hosts).where(F.col("n_names") >= least_names)
    return sorted(row["host"] for row in found.collect())


def longest_listed(sites: DataFrame, domains: DataFrame) -> DataFrame:
    """``site, listed``: for each different *site* the longest of *domains* (``domain``) that is it or lies above it.

    A site becomes its label suffixes, and those meet the table by an equi-join. Only suffixes of as many labels as any domain has
    are made, so that nothing is looked up under ``com`` unless the table lists such a name itself.
    """
    listed = settle(domains.select(F.lower(F.btrim("domain")).alias("listed")).where("listed <> ''").distinct())
    labels = F.size(F.split("listed", r"\."))
    # A host name has at most 127 labels.
    sizes = [row["n"] for row in listed.select(labels.alias("n")).where("n <= 127").distinct().orderBy("n").collect()]
    if not sizes:
        return sites.limit(0).select("site", F.col("site").alias("listed"))
    count = F.size(F.split("site", r"\."))
    suffixes = F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= count)
    made = sites.select("site", F.explode(F.transform(suffixes, lambda n: F.call_function("substring_index", F.col("site"), F.lit("."), -n))).alias("listed"))
    met = made.join(listed, "listed", "left_semi")
    return met.groupBy("site").agg(F.max_by("listed", F.length("listed")).alias("listed"))


def with_listed_domain(leads: DataFrame, domains: DataFrame, legacy_hosts: bool = False, spread: str = "lead_id") -> DataFrame:
    """Add ``listed``: the longest of *domains* that a lead's website is on, else null.

    Sites are matched once each, however many leads they have; a hot site is salted on its way back.
    """
    keyed = leads.withColumn("site", site_key(F.col("website"), legacy_hosts))
    sites = keyed.where("site is not null").select("site").distinct()
    return skew_join(keyed, settle(longest_listed(sites, domains)), "site", spread).drop("site")
