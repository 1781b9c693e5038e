"""The whole run: landed tables in, ranked leads out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Observation, functions as F

from leadweave.config import Settings, output_base
from leadweave.operators import enrich, filters, relevance, score
from leadweave.operators.dedup import duplicate_slots
from leadweave.operators.hosts import with_listed_domain
from leadweave.operators.merge import merge_duplicates
from leadweave.session import settle
from leadweave.sinks.export import export
from leadweave.sources.registry import discover, source_counts
from leadweave.sources.result_pages import place_addresses


@dataclass
class LandedTables:
    """Inputs of a run. Give ``raw_leads``, or the result pages of the sources used."""

    crawl: DataFrame
    raw_leads: DataFrame | None = None
    feed_pages: DataFrame | None = None
    place_pages: DataFrame | None = None
    directory_pages: DataFrame | None = None
    lookup_pages: DataFrame | None = None
    search_pages: DataFrame | None = None
    # Addresses for the back-fill: ready ones, or the landed map searches for single leads.
    places: DataFrame | None = None
    address_pages: DataFrame | None = None
    verdicts: DataFrame | None = None
    # Further domains whose sites the junk filter drops, in ``domain``; a table of any length.
    junk_domains: DataFrame | None = None


@dataclass
class LeadRun:
    """Outcome: ``kept`` and ``refused`` leads, unordered, and counters filled by the first action."""

    kept: DataFrame
    refused: DataFrame | None
    sources: DataFrame  # sightings found per source
    counters: dict[str, Observation] = field(default_factory=dict)

    def ranked(self) -> DataFrame:
        return score.ranked(self.kept)

    def counts(self) -> dict[str, int]:
        """Rows after each stage. Call it after an action on the results."""
        return {k: n for o in self.counters.values() for k, n in o.get.items()}


def merged_leads(
    sightings: DataFrame, mode: str = "exact", legacy_hosts: bool = False, ignore_hosts: Sequence[str] = ()
) -> DataFrame:
    """Merge the duplicates among sightings that carry ``seq`` and ``sources``."""
    absent = [F.lit(None).cast("string").alias(c) for c in ("email", "contact_page") if c not in sightings.columns]
    records = sightings.select("*", *absent)
    return merge_duplicates(records, duplicate_slots(sightings, mode, legacy_hosts, ignore_hosts))


def run(tables: LandedTables, settings: Settings) -> LeadRun:
    counters: dict[str, Observation] = {}

    def counted(df: DataFrame, stage: str, *more) -> DataFrame:
        counters[stage] = Observation(stage)
        return df.observe(counters[stage], F.count(F.lit(1)).alias(stage), *more)

    # Source parsing runs once; the keys and the merge both read the result.
    sightings = settle(counted(discover(tables, settings), "discovered"))
    found = source_counts(sightings)
    merged = merged_leads(sightings, settings.dedup_mode, settings.legacy_hosts, settings.ignore_hosts)
    # The joins count their hot keys on the merged leads, so these are written once.
    merged = settle(counted(merged, "merged"))
    counters["pages"] = Observation("pages")
    leads = filters.valid_leads(enrich.enriched(
        merged, tables.crawl, settings.contact_paths, settings.max_description_length, counters["pages"], settings.strict_spelled_out
    ))
    places = tables.places
    if places is None and tables.address_pages is not None:
        places = place_addresses(tables.address_pages, tables.place_pages)
    if settings.address_backfill and places is not None:
        leads = enrich.with_backfilled_address(leads, places, settings.location, earlier=merged)
        leads = counted(leads, "valid", F.count_if("address_filled").alias("addresses_filled"))
        leads = leads.drop("address_filled")
    else:
        leads = counted(leads, "valid")
    leads = score.scored(leads, settings.weights)
    if settings.filter_junk:
        listed = None
        if tables.junk_domains is not None:
            # Sites and hot keys are looked up on the leads first, so these are written once.
            leads = with_listed_domain(settle(leads), tables.junk_domains, settings.legacy_hosts)
            listed = F.col("listed").isNotNull()
        reason = filters.drop_reason(
            settings.filter_empty, settings.legacy_hosts, settings.junk_sites, settings.junk_name_parts, listed
        )
        leads = leads.withColumn("reason", reason)
        leads = counted(leads, "scored", *[
            F.count_if(F.col("reason") == r).alias(f"dropped_{r}") for r in ("domain", "name", "empty")
        ])
        leads = leads.where(F.col("reason").isNull()).drop("reason", "listed")
    leads = filters.with_fields(leads, settings.only)
    leads = counted(score.with_min_score(leads, settings.min_score, settings.weights), "selected")
    if tables.verdicts is None:
        return LeadRun(settle(leads), None, found, counters)
    # Written once: both halves read it.
    judged = settle(relevance.judged(leads, tables.verdicts, settings.accepted_answers))
    kept, refused = (judged.where(F.col("kept") == flag).drop("kept") for flag in (True, False))
    return LeadRun(kept, refused, found, counters)


def run_and_export(tables: LandedTables, settings: Settings, at: datetime | None = None) -> list[str]:
    """Run and write the kept and the refused leads; both names share one time."""
    outcome = run(tables, settings)
    at = at or datetime.now()
    paths = []
    for leads, refused in ((outcome.kept, False), (outcome.refused, True)):
        if leads is not None:
            base = f"{settings.output_dir}/{output_base(settings, at, refused)}"
            paths += export(score.ranked(leads), base, settings.output_format)
    return paths
