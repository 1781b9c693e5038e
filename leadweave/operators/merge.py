"""Merging the sightings of one company into one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadweave.functions.text import present


def _earliest(c: str) -> Column:
    """The earliest present value; when all are missing, the latest one as it is."""
    there = present(F.col(c))
    order = F.struct(~there, F.when(there, F.col("seq")).otherwise(-F.col("seq")))
    return F.min_by(c, order).alias(c)


def _longest(c: str) -> Column:
    """The longest value, the earliest of equals; when all are missing, the latest as it is."""
    size = F.coalesce(F.length(c), F.lit(0))
    order = F.struct(size, F.when(size > 0, -F.col("seq")).otherwise(F.col("seq")))
    return F.max_by(c, order).alias(c)


def merged_sources(records: DataFrame, slot: str) -> DataFrame:
    """``slot, every``: the distinct sources of each slot, sorted. Repeats go before any list is made."""
    pairs = records.select(slot, F.explode("sources").alias("source")).where("source is not null").distinct()
    return pairs.groupBy(slot).agg(F.array_sort(F.collect_list("source")).alias("every"))


def merge_records(records: DataFrame, slot: str) -> DataFrame:
    """One lead per *slot*. Every aggregate combines before the shuffle and has a bounded state."""
    alone = F.min("seq") == F.max("seq")
    merged = records.groupBy(slot).agg(
        _earliest("company_name"), _earliest("website"), _earliest("email"),
        _longest("description"), _earliest("contact_page"), _earliest("address"),
        F.when(alone, F.min_by("sources", "seq")).alias("own"),
        F.when(~alone, F.lit(True)).alias("several"),
        F.lit(0).alias("score"),
        F.min("seq").alias("seq"),
    )
    every = F.coalesce("every", F.array().cast("array<string>"))
    joined = merged.join(merged_sources(records, slot), slot, "left")
    sources = F.when(F.col("several"), every).otherwise(F.col("own"))
    columns = [c for c in merged.columns if c not in ("own", "several")]
    return joined.withColumn("sources", sources).select(*columns[:-2], "sources", *columns[-2:])


def merge_duplicates(records: DataFrame, slots: DataFrame) -> DataFrame:
    """Leads from records and their ``(seq, slot)``; a lead keeps the first ``seq`` of its records."""
    merged = merge_records(records.join(slots, "seq"), "slot")
    return merged.withColumnRenamed("slot", "lead_id")
