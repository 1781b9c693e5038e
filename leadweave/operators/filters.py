"""Junk filter, required fields, validity, and the reports on them."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from leadweave.fixed_values import JUNK_NAME_PARTS, JUNK_SITES, REQUIRED_FIELDS
from leadweave.functions.text import matches_any, present, strip
from leadweave.functions.url import on_listed_site, site


def valid_leads(leads: DataFrame) -> DataFrame:
    return leads.where(present(strip(F.col("company_name"))))


def is_junk_site(legacy_hosts: bool = False, sites: Iterable[str] = JUNK_SITES) -> Column:
    return on_listed_site(site(F.col("website"), legacy_hosts), sites)


def is_junk_name(parts: Iterable[str] = JUNK_NAME_PARTS) -> Column:
    return matches_any(F.lower("company_name"), parts)


def is_empty_record() -> Column:
    return reduce(and_, [~present(F.col(c)) for c in REQUIRED_FIELDS.values()])


def drop_reason(
    filter_empty: bool = True, legacy_hosts: bool = False, sites: Iterable[str] = JUNK_SITES,
    name_parts: Iterable[str] = JUNK_NAME_PARTS, listed: Column | None = None,
) -> Column:
    """``domain``, ``name`` or ``empty``, the first that applies; null for a lead to keep.

    *listed* tells which leads a table of domains names as well.
    """
    junk_site = is_junk_site(legacy_hosts, sites)
    reason = F.when(junk_site if listed is None else listed | junk_site, "domain").when(is_junk_name(name_parts), "name")
    return reason.when(is_empty_record(), "empty") if filter_empty else reason


def without_junk(leads: DataFrame, filter_empty: bool = True, legacy_hosts: bool = False) -> DataFrame:
    return leads.where(drop_reason(filter_empty, legacy_hosts).isNull())


def drop_report(leads: DataFrame, filter_empty: bool = True, legacy_hosts: bool = False, reason: Column | None = None) -> DataFrame:
    """How many leads each reason drops, and how many stay; *reason* is a :func:`drop_reason` with other lists."""
    reason = F.coalesce(drop_reason(filter_empty, legacy_hosts) if reason is None else reason, F.lit("kept"))
    return leads.groupBy(reason.alias("reason")).agg(F.count("*").alias("n_leads"))


def with_fields(leads: DataFrame, keywords: list[str]) -> DataFrame:
    """Leads that have all fields named by the keywords."""
    for keyword in keywords:
        leads = leads.where(present(F.col(REQUIRED_FIELDS[keyword])))
    return leads
