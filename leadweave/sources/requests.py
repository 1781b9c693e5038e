"""The pages to fetch for a search, as a table of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadweave.fixed_values import DIRECTORY_URL, LOOKUP_URL, MAPS_URL, SEARCH_URL
from leadweave.functions.name import location_slug
from leadweave.functions.url import form_encoded


def _filled(template: str, **parts: Column) -> Column:
    url = F.lit(template)
    for name, value in parts.items():
        url = F.replace(url, F.lit("{%s}" % name), value)
    return url


def search_requests(searches: DataFrame) -> DataFrame:
    """One row per search and source, from ``(query, location)``."""
    term = F.concat_ws(" ", "query", "location")
    encoded = form_encoded(term)
    directory = _filled(
        DIRECTORY_URL, what=form_encoded(F.col("query")),
        where=form_encoded(location_slug(F.col("location"))), page=F.lit("1"),
    )
    rows = F.array(
        F.struct(F.lit("maps").alias("source"), F.concat(F.lit(MAPS_URL), encoded).alias("url")),
        F.struct(F.lit("pj").alias("source"), directory.alias("url")),
        F.struct(F.lit("google").alias("source"), _filled(SEARCH_URL, term=encoded).alias("url")),
    )
    return searches.select("query", "location", term.alias("search_term"), F.inline(rows))


def lead_requests(leads: DataFrame, location: str) -> DataFrame:
    """Look-up addresses for each lead: its place, and its own site."""
    term = F.concat("company_name", F.lit(f" {location}"))
    encoded = form_encoded(term)
    return leads.select(
        "lead_id", term.alias("search_term"),
        F.concat(F.lit(MAPS_URL), encoded).alias("place_url"),
        _filled(LOOKUP_URL, term=encoded).alias("lookup_url"),
    )
