"""Lead score and its bounds."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from leadweave.config import ScoreWeights
from leadweave.functions.email import is_free_email
from leadweave.functions.text import present

DEFAULT = ScoreWeights()
MAX_SCORE, MIN_SCORE = DEFAULT.most, DEFAULT.least


def lead_score(weights: ScoreWeights = DEFAULT) -> Column:
    fields = [F.when(present(F.col(c)), points).otherwise(0) for c, points in weights.fields.items()]
    email = F.when(
        present(F.col("email")),
        F.when(is_free_email(F.col("email")), weights.free_email).otherwise(weights.business_email),
    ).otherwise(0)
    seen_by = F.coalesce(F.size(F.array_distinct("sources")), F.lit(0))
    several = F.when(seen_by >= 2, weights.several_sources).otherwise(0)
    return reduce(add, [*fields, email, several]).cast("int")


def scored(leads: DataFrame, weights: ScoreWeights = DEFAULT) -> DataFrame:
    return leads.withColumn("score", lead_score(weights))


def with_min_score(leads: DataFrame, least: int, weights: ScoreWeights = DEFAULT) -> DataFrame:
    """Leads with at least this score; the lowest possible score keeps all."""
    return leads if least <= weights.least else leads.where(F.col("score") >= least)


def ranked(leads: DataFrame) -> DataFrame:
    """Best first; equals in arrival order."""
    return leads.orderBy(F.desc("score"), F.asc("seq"))
