"""Relevance requests for an outside judge, and the split by its verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from leadweave.fixed_values import ACCEPTED_ANSWERS
from leadweave.functions.text import first_present, strip

# Fixed value: stands for a missing description.
NO_DESCRIPTION = "Non disponible"


def relevance_requests(leads: DataFrame, query: str) -> DataFrame:
    """One request text per lead."""
    text = F.concat_ws(
        "\n",
        F.concat(F.lit(f"Query: {query}"), F.lit("\nCompany: "), "company_name"),
        F.concat(F.lit("Website: "), F.coalesce("website", F.lit(""))),
        F.concat(F.lit("Description: "), first_present(F.col("description"), F.lit(NO_DESCRIPTION))),
        F.lit(f"Does the company's main activity match '{query}'? Answer 'oui' or 'non'."),
    )
    return leads.select(F.col("lead_id").alias("lead_key"), text.alias("request"))


def keeps(answer: Column, error: Column, accepted: Sequence[str] = ACCEPTED_ANSWERS) -> Column:
    """An answer that begins like an *accepted* one keeps, any other refuses, an error keeps."""
    said = F.lower(strip(F.coalesce(answer, F.lit(""))))
    kept = error.isNotNull()
    for start in accepted:
        kept = kept | F.startswith(said, F.lit(start.lower()))
    return kept


def judged(leads: DataFrame, verdicts: DataFrame, accepted: Sequence[str] = ACCEPTED_ANSWERS) -> DataFrame:
    """Leads with a ``kept`` flag. A lead without verdict counts as an error; of several verdicts on a lead
    one that keeps it is enough."""
    kept = keeps(F.col("answer"), F.col("error"), accepted)
    flags = verdicts.groupBy(F.col("lead_key").alias("lead_id")).agg(F.bool_or(kept).alias("kept"))
    return leads.join(flags, "lead_id", "left").withColumn("kept", F.coalesce("kept", F.lit(True)))
