"""Ranked business leads from raw company sightings and crawled pages, on Spark DataFrames."""

from leadweave.config import Settings, parse_only, parse_sources
from leadweave.plans.lead_run import LandedTables, LeadRun, run

__all__ = ["LandedTables", "LeadRun", "Settings", "parse_only", "parse_sources", "run"]
