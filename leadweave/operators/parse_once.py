"""Features of crawled pages where each distinct content is parsed once.

Reading a page costs little beside parsing it, so the crawl is scanned twice and never moved. The first scan takes
a digest of the HTML and the place of the row; the least place of each digest speaks for all its copies. The second scan parses the rows
at these places only: a Bloom filter over the places, 32 MB at most, is tested before the HTML is parsed. It lets a few other copies
through, more of them beyond some 16 million contents, and never holds a content back. The short features go back to all rows of
their digest; a digest that many URLs share, such as a parked page, is spread by salts.

The crawl must be a scan of landed Parquet files (filters and derived columns are fine): rows are told apart by
file and row number, which both scans see alike, also after a lost task.

Defined cases: pages without HTML, or with empty HTML, share one content; a page that cannot be parsed gives null features to all its
copies; equal rows count once, as in :func:`enrich.page_features`; an empty crawl gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from leadweave.fixed_values import DESCRIPTION_LENGTH
from leadweave.operators import enrich
from leadweave.operators.key_filter import key_filter
from leadweave.operators.skew import skew_join
from leadweave.session import settle

_FOUND = ("email", "strategy", "description", "has_html", "unread")


def _place() -> Column:
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def first_copies(crawl: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``url, digest`` of all usable rows, and the rows to parse with their ``digest``: one per digest, and few more."""
    digest = F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256))
    pages = enrich.usable_pages(crawl.withColumn("place", _place()))
    seen = settle(pages.select("url", "place", digest.alias("digest")))
    speaking = settle(seen.groupBy("digest").agg(F.min("place").alias("place")).select("place"))
    first = pages.where(key_filter(speaking).may_hold(F.col("place"))).withColumn("digest", digest).drop("place")
    return seen.select("url", "digest"), first


def page_features(
    crawl: DataFrame, length: int = DESCRIPTION_LENGTH, strict: bool = False, parsed: Observation | None = None
) -> DataFrame:
    """As :func:`enrich.page_features`. *parsed* counts the pages that were parsed, as ``pages_parsed``."""
    seen, first = first_copies(crawl)
    if parsed is not None:
        first = first.observe(parsed, F.count(F.lit(1)).alias("pages_parsed"))
    found = enrich.with_description(enrich.page_contacts(first, strict), length).select("digest", *_FOUND)
    found = settle(found).dropDuplicates(["digest"])
    return enrich.one_per_url(skew_join(seen, found, "digest", "url").drop("digest"))
