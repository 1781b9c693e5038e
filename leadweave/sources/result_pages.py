"""Rows from landed result pages: places, directory cards, search hits.

Everything that belongs to one page is settled inside the page's row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadweave.fixed_values import SEARCH_SKIP_SITES, TITLE_SUFFIXES
from leadweave.functions import dom, html as H
from leadweave.functions.text import cut_snippet, present, strip
from leadweave.functions.url import on_listed_site, resolved, site

def result_order(page: str, pos: str) -> Column:
    """What orders the results of a search: the page's number, of any size, then the place on the page."""
    return F.struct(F.col(page).cast("long").alias("page_no"), F.col(pos).cast("long").alias("pos"))


def _first_of_each(rows: Column, key) -> Column:
    """Rows of an array whose key has not come before in it."""
    keys = F.transform(rows, key)
    return F.filter(rows, lambda r, i: F.array_position(keys, key(r)) == i + 1)


def place_urls(feed_pages: DataFrame) -> DataFrame:
    """Distinct place links per search with their first place, from ``(search_term, page_no, html)``.

    With a column ``url``, the address of the page, relative links are resolved.
    """
    links = F.filter(
        H.link_targets(H.markup(F.col("html"))), lambda t: F.contains(t, F.lit("/maps/place/"))
    )
    if "url" in feed_pages.columns:
        links = F.transform(links, lambda t: F.coalesce(resolved(t, F.col("url")), t))
    seen = feed_pages.select("search_term", "page_no", F.posexplode(links).alias("pos", "url"))
    return seen.groupBy("search_term", "url").agg(F.min(result_order("page_no", "pos")).alias("place_order"))


def place_rows(place_pages: DataFrame) -> DataFrame:
    """Name, address and website of each place ``(url, html)``; places without a name are dropped."""
    return _places(place_pages, "company_name", "address").where(F.col("company_name").isNotNull())


def _first_text(texts: str) -> Column:
    return F.get(F.filter(texts, lambda v: present(v)), F.lit(0))


def _places(place_pages: DataFrame, *first: str) -> DataFrame:
    """One row per URL. Of several pages, one with the *first* fields counts first, then the least by its fields."""
    read = place_pages.select("url", dom.place_fields("html").alias("f")).select("url", "f.*")
    found = read.select(
        "url", _first_text("names").alias("company_name"), _first_text("addresses").alias("address"),
        F.get(F.filter("hrefs", lambda h: F.startswith(h, F.lit("http"))), F.lit(0)).alias("website"),
    )
    fields = ("company_name", "address", "website")
    order = F.struct(
        *[F.col(c).isNull().alias(f"no_{c}") for c in first], *[F.coalesce(c, F.lit("")).alias(f"by_{c}") for c in fields]
    )
    best = found.groupBy("url").agg(F.min_by(F.struct(*fields), order).alias("best"))
    return best.select("url", *[F.col(f"best.{c}").alias(c) for c in fields])


def place_addresses(feed_pages: DataFrame, place_pages: DataFrame) -> DataFrame:
    """Per search of a map: the address on the landed page itself, and that of the first linked place.

    The first place counts even if its page has no address or has not landed. *feed_pages* are
    ``(search_term, page_no, html)``, with or without ``url``.
    """
    shown = feed_pages.select("search_term", "page_no", dom.place_fields("html")["addresses"].alias("addresses"))
    shown = shown.withColumn("shown", _first_text("addresses"))
    direct = shown.groupBy("search_term").agg(
        F.min_by("shown", F.when(F.col("shown").isNotNull(), F.struct("page_no", "shown"))).alias("direct_address")
    )
    firsts = place_urls(feed_pages).groupBy("search_term").agg(F.min_by("url", F.struct("place_order", "url")).alias("url"))
    asked = place_pages.join(firsts.select("url").distinct(), "url", "left_semi")
    linked = firsts.join(_places(asked, "address").select("url", "address"), "url", "left").select("search_term", "address")
    return direct.join(linked, "search_term", "left").select("search_term", "direct_address", F.lit(1).alias("pos"), "address")


def directory_cards(directory_pages: DataFrame) -> DataFrame:
    """Cards of ``(search_term, page_no, html)``, each name once per page."""
    named = F.filter(dom.headed_items("html"), lambda i: F.length(i["name"]) >= 2)
    once = directory_pages.withColumn("items", named).select(
        "search_term", "page_no", F.posexplode(_first_of_each(F.col("items"), lambda i: i["name"])).alias("pos", "card")
    )
    # The first place that is there counts, even if it is empty.
    address = F.get(F.filter("card.addresses", lambda a: a.isNotNull()), F.lit(0))
    return once.select("search_term", "page_no", "pos", "card.name", F.nullif(address, F.lit("")).alias("address"))


def _with_hits(pages: DataFrame) -> DataFrame:
    """Add ``hits`` to result pages ``(search_term, page_no, url, html)``."""

    def is_hit(h):
        own = F.contains(h["href"], F.lit("google.")) & ~F.contains(h["href"], F.lit("url="))
        return F.coalesce(F.startswith(h["href"], F.lit("http")) & ~own, F.lit(False))

    def read(h):
        # The nearest place that there is holds the snippet, or there is none.
        note = F.get(F.filter(h["snippets"], lambda s: s.isNotNull()), F.lit(0))
        return F.struct(h["href"].alias("href"), h["title"].alias("title"), F.coalesce(note, F.lit("")).alias("snippet"))

    headings = pages.withColumn("headings", dom.linked_headings("html", "url"))
    return headings.withColumn("hits", F.transform(F.filter("headings", is_hit), read)).drop("headings")


def search_hits(pages: DataFrame) -> DataFrame:
    return _with_hits(pages).select(
        "search_term", "page_no", F.posexplode("hits").alias("pos", "hit")
    ).select("search_term", "page_no", "pos", "hit.href", "hit.title", "hit.snippet")


def clean_title(title: Column) -> Column:
    """Cut each known ending once, in order, whatever its case."""
    for suffix in TITLE_SUFFIXES:
        ends = F.endswith(F.lower(title), F.lit(suffix))
        shorter = strip(F.substring(title, F.lit(1), F.length(title) - len(suffix)))
        title = F.when(ends, shorter).otherwise(title)
    return title


def search_leads(pages: DataFrame, legacy_hosts: bool = False) -> DataFrame:
    """Leads among the hits: no listed sites, one per site and page."""

    def of_site(hit):
        return F.coalesce(site(hit["href"], legacy_hosts), F.lit(""))

    def skipped(hit):
        if legacy_hosts:
            return of_site(hit).rlike("(?:%s)$" % "|".join(s.replace(".", r"\.") for s in SEARCH_SKIP_SITES))
        return on_listed_site(of_site(hit), SEARCH_SKIP_SITES)

    usable = F.filter("hits", lambda h: F.startswith(h["href"], F.lit("http")) & present(strip(h["title"])) & ~skipped(h))
    kept = _with_hits(pages).withColumn("usable", usable).select(
        "search_term", "page_no", F.posexplode(_first_of_each(F.col("usable"), of_site)).alias("pos", "hit")
    )
    return kept.select(
        "search_term", "page_no", "pos",
        clean_title(strip(F.col("hit.title"))).alias("company_name"),
        F.col("hit.href").alias("website"),
        cut_snippet(F.nullif(strip(F.col("hit.snippet")), F.lit(""))).alias("description"),
    )
