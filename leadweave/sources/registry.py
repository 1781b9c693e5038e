"""Sources by name, and their union into one table of sightings.

A source is a function of the landed tables and the settings. It returns ``company_name``,
``website``, ``description``, ``address`` and ``source_rank``, the position among its results.
A new source is one more entry of ``SOURCES``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from leadweave.operators.enrich import lookup_term, with_looked_up_site
from leadweave.operators.skew import first_per_group, ranked_by_page
from leadweave.session import settle
from leadweave.sources import result_pages as R

# Above any rank; a rank beyond it is an error.
_RUN_STEP = 1 << 52


def _of_search(pages: DataFrame, settings) -> DataFrame:
    return pages.where(F.col("search_term") == settings.search_term)


def _limited(results: DataFrame, settings) -> DataFrame:
    """The first results of the search with their rank among all of them; *results* are read twice.

    Without a limit, ranks are counted page by page: the results of the pages before, then the place on the page.
    """
    if settings.limit is not None:
        return first_per_group(results, ["search_term"], "place_order", settings.limit, "source_rank")
    placed = results.withColumn("page", F.col("place_order.page_no"))
    return ranked_by_page(placed, ["search_term"], "page", "place_order", "source_rank").drop("page")


def _columns(df: DataFrame) -> DataFrame:
    absent = [F.lit(None).cast("string").alias(c) for c in ("website", "description", "address") if c not in df.columns]
    return df.select("*", *absent).select("company_name", "website", "description", "address", "source_rank")


def maps_source(tables, settings) -> DataFrame:
    """Place pages of the first place links. The limit counts links, before names are read."""
    # Written, the links have a known size: a short list is broadcast, and only its pages are parsed.
    urls = settle(R.place_urls(_of_search(tables.feed_pages, settings)))
    urls = settle(_limited(urls, settings).select("url", "source_rank"))
    pages = tables.place_pages.join(urls.select("url"), "url", "left_semi")
    return _columns(R.place_rows(pages).join(urls, "url"))


def directory_source(tables, settings) -> DataFrame:
    """The first directory cards, with websites looked up by name."""
    cards = R.directory_cards(_of_search(tables.directory_pages, settings))
    cards = cards.withColumn("place_order", R.result_order("page_no", "pos")).withColumnRenamed("name", "company_name")
    # What follows reads the cards several times; their pages should be parsed once.
    cards = _limited(settle(cards), settings)
    cards = settle(cards.select("company_name", "address", "source_rank", F.lit(None).cast("string").alias("website")))
    asked = cards.select(lookup_term(settings.location).alias("search_term"))
    hits = R.search_hits(tables.lookup_pages.join(asked, "search_term", "left_semi"))
    return _columns(with_looked_up_site(cards, hits, settings.location, "source_rank"))


def search_source(tables, settings) -> DataFrame:
    """The first leads among the search hits."""
    leads = R.search_leads(_of_search(tables.search_pages, settings), settings.legacy_hosts)
    leads = leads.withColumn("place_order", R.result_order("page_no", "pos"))
    return _columns(_limited(settle(leads), settings))


SOURCES = {"maps": maps_source, "pj": directory_source, "google": search_source}


def landed(raw_leads: DataFrame, names: list[str], limit: int | None = None) -> DataFrame:
    """Landed sightings of the chosen sources in run order; a source named twice comes twice."""
    runs: dict[str, list[int]] = {}
    for position, name in enumerate(names):
        runs.setdefault(name, []).append(position)
    chosen = raw_leads.where(F.col("source").isin(list(runs)))
    if limit is not None:
        chosen = first_per_group(chosen, ["source"], "source_rank", limit, "taken").drop("taken")
    positions = F.coalesce(*[F.when(F.col("source") == n, F.array(*map(F.lit, p))) for n, p in runs.items()])
    return chosen.withColumn("run_pos", F.explode(positions))


def union_sources(frames: list[tuple[str, DataFrame]]) -> DataFrame:
    """Sightings of all sources in run order, tagged with their source."""
    parts = [
        frame.withColumn("source", F.lit(name)).withColumn("run_pos", F.lit(position))
        for position, (name, frame) in enumerate(frames)
    ]
    return arrived(reduce(DataFrame.unionByName, parts))


def arrived(sightings: DataFrame) -> DataFrame:
    """Add the arrival order ``seq`` and the tag.

    ``seq`` packs run position and rank, so no global numbering is needed. A rank that does not fit fails.
    """
    tag = F.array("source")
    tags = F.array_union("sources", tag) if "sources" in sightings.columns else tag
    fits = (F.col("source_rank") >= 0) & (F.col("source_rank") < _RUN_STEP)
    seq = F.when(fits, F.col("run_pos") * F.lit(_RUN_STEP) + F.col("source_rank")).otherwise(
        F.raise_error(F.lit("source_rank must lie between 0 and 2^52")).cast("long")
    )
    return sightings.withColumn("seq", seq).withColumn("sources", tags)


def source_counts(sightings: DataFrame) -> DataFrame:
    """Sightings per source, from their tags."""
    return sightings.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("n_leads"))


def discover(tables, settings) -> DataFrame:
    """All sightings of a run, from landed sightings if there are any, else from result pages."""
    if tables.raw_leads is not None:
        return arrived(landed(tables.raw_leads, settings.sources, settings.limit))
    return union_sources([(name, SOURCES[name](tables, settings)) for name in settings.sources])
