"""Which sightings are the same company.

*Exact* mode gives what one pass in arrival order gives that keeps two tables, site to company and
name to company: a sighting joins the company of its site if that site was seen before, else that
of its name, else it opens a new one; afterwards both its keys point to that company.

No pass is needed. A site's entry never changes after its first sighting, so every later sighting
of the site goes where the first one went. A name's entry changes, but only a sighting that was
placed by its site can move it elsewhere. So every sighting has one earlier link:

* placed by its site: the site's first sighting;
* placed by its name: the latest earlier sighting of that name that was placed by its site,
  or else the first sighting of the name.

Following the links from site to site by pointer doubling takes a number of rounds that is
logarithmic in the longest chain.

*Closure* mode joins everything connected by shared names and sites. It starts from the exact
companies and connects those that share a name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from leadweave.functions.name import name_key
from leadweave.functions.url import on_listed_site, site_key
from leadweave.operators.skew import spread_min, with_bucket
from leadweave.session import discard, settle


def duplicate_keys(sightings: DataFrame, legacy_hosts: bool = False, ignore_hosts: Sequence[str] = ()) -> DataFrame:
    """``seq, site, name``; a site on one of *ignore_hosts*, or below one, is no key."""
    site = site_key(F.col("website"), legacy_hosts)
    return sightings.select(
        "seq",
        (F.when(~on_listed_site(site, ignore_hosts), site) if ignore_hosts else site).alias("site"),
        F.nullif(name_key(F.col("company_name")), F.lit("")).alias("name"),
    )


def exact_slots(keys: DataFrame) -> DataFrame:
    """``(seq, name, slot)``: the slot is the ``seq`` of the company's first sighting."""
    # The bounds of the buckets read seq only, before any key is computed.
    keys = settle(with_bucket(keys, "seq", "bucket"))
    if not keys.groupBy("seq").count().where("count > 1").isEmpty():
        raise ValueError("seq must be unique among sightings")
    on_site = F.col("site").isNotNull()
    firsts = keys.where(on_site).groupBy("site").agg(F.min("seq").alias("seq"))
    marked = keys.join(firsts.select("seq", F.lit(True).alias("opens")), "seq", "left")
    links = settle(_name_links(marked))
    sites = _site_slots(links.where(on_site).select("site", "parent", "root"))
    routes = keys.where(on_site).select(
        "seq", "name", F.col("site").alias("via"), F.lit(None).cast("long").alias("own")
    ).unionByName(
        links.where(~on_site).select("seq", "name", F.col("parent").alias("via"), F.col("root").alias("own"))
    )
    # One row per site on the right: adaptive execution splits a hot site, or the rows without one.
    placed = routes.join(sites.select(F.col("site").alias("via"), "root"), "via", "left")
    return placed.select("seq", "name", F.coalesce("root", "own").alias("slot"))


def _name_links(marked: DataFrame) -> DataFrame:
    """For each sighting not placed by its site: the site it follows, or its root."""
    by_site = F.when(F.col("site").isNotNull() & F.col("opens").isNull(), F.col("site"))
    unnamed = marked.where(F.col("name").isNull() & by_site.isNull()).select(
        "seq", "site", "name", F.lit(None).cast("string").alias("parent"), F.col("seq").alias("root")
    )
    # A hot name is cut into buckets of seq; what a bucket hands on to the later ones is one row.
    # Both branches below read this one shuffle: they need the same columns and the same filter.
    cells = marked.where(F.col("name").isNotNull() & F.col("bucket").isNotNull())
    cells = cells.repartition("name", "bucket").withColumn("by_site", by_site)
    earlier = Window.partitionBy("name", "bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    within = cells.withColumn("latest", F.last("by_site", ignorenulls=True).over(earlier))
    handed = cells.groupBy("name", "bucket").agg(
        F.max_by("by_site", F.when(F.col("by_site").isNotNull(), F.col("seq"))).alias("last_site"),
        F.min("seq").alias("opened"),
    )
    before = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    handed = handed.select(
        "name", "bucket",
        F.last("last_site", ignorenulls=True).over(before).alias("carried"),
        F.min("opened").over(Window.partitionBy("name")).alias("opened"),
    )
    named = within.where(F.col("by_site").isNull()).join(handed, ["name", "bucket"])
    parent = F.coalesce("latest", "carried")
    return named.select(
        "seq", "site", "name", parent.alias("parent"),
        F.when(parent.isNull(), F.col("opened")).alias("root"),
    ).unionByName(unnamed)


def _site_slots(links: DataFrame) -> DataFrame:
    """``(site, root)`` from ``(site, parent, root)``, doubling the step each round.

    A round writes the links that are still open, and those that it has closed, apart: what was closed
    before is not written again.
    """
    closed = links.where(F.col("root").isNotNull()).select("site", "root")
    open_ = links.where(F.col("root").isNull()).select("site", "parent")
    while not open_.isEmpty():
        target = closed.select(F.col("site").alias("parent"), F.lit(None).cast("string").alias("next"), "root").unionByName(
            open_.select(F.col("site").alias("parent"), F.col("parent").alias("next"), F.lit(None).cast("long").alias("root"))
        )
        moved = settle(open_.join(target, "parent", "left").select("site", F.col("next").alias("parent"), "root"))
        closed = closed.unionByName(moved.where(F.col("root").isNotNull()).select("site", "root"))
        open_ = moved.where(F.col("root").isNull()).select("site", "parent")
    return closed


def closure_slots(keys: DataFrame) -> DataFrame:
    """As :func:`exact_slots`, with all connected sightings in one slot."""
    exact = settle(exact_slots(keys))
    pairs = exact.where(F.col("name").isNotNull()).select("name", "slot").distinct()
    low = spread_min(pairs, "name", "slot", "slot", "low")
    stars = _stars(low.where(F.col("slot") != F.col("low")).select(F.col("slot").alias("a"), F.col("low").alias("b")).distinct())
    joined = exact.join(stars.select(F.col("a").alias("slot"), "b"), "slot", "left")
    return joined.select("seq", "name", F.coalesce("b", "slot").alias("slot"))


def _stars(edges: DataFrame) -> DataFrame:
    """Connected components of edges ``a > b``, as one edge from each node to its least one.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until only stars are left.
    """
    edges = settle(edges)
    while not _is_star_forest(edges):
        before = edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = spread_min(both, "a", "b", "b", "low")
        large = low.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()
        low = spread_min(large, "a", "b", "b", "low")
        small = low.where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.unionByName(low.select("a", F.col("low").alias("b")))
        edges = settle(small.distinct())
        discard(before)
    return edges


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether no node has two centres and no centre has one."""
    nodes = edges.unionByName(edges.select(F.col("b").alias("a"), "b"))
    centres = nodes.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    return centres.where(F.col("low") != F.col("high")).isEmpty()


def duplicate_slots(
    sightings: DataFrame, mode: str = "exact", legacy_hosts: bool = False, ignore_hosts: Sequence[str] = ()
) -> DataFrame:
    """``(seq, slot)`` for every sighting. A repeated ``seq`` is an error."""
    keys = duplicate_keys(sightings, legacy_hosts, ignore_hosts)
    slots = exact_slots(keys) if mode == "exact" else closure_slots(keys)
    return slots.select("seq", "slot")
