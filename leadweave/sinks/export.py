"""JSON and CSV exports and the summary listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadweave.fixed_values import SUMMARY_LENGTH
from leadweave.operators.score import MAX_SCORE, ranked
from leadweave.operators.skew import numbered
from leadweave.schema import EXPORT_COLUMNS

_BOM = "\ufeff"


def _clean(leads: DataFrame) -> DataFrame:
    """The exported columns; an empty source list becomes null and is left out of JSON."""
    return leads.select(
        *[F.when(F.size("sources") > 0, F.col("sources")).alias(c) if c == "sources" else c for c in EXPORT_COLUMNS]
    )


def json_record(leads: DataFrame) -> DataFrame:
    """One JSON text per lead, without null fields and empty lists."""
    return _clean(leads).select(F.to_json(F.struct(*EXPORT_COLUMNS)).alias("record"))


def write_json(leads: DataFrame, path: str) -> None:
    """JSON Lines, one file per partition, in the order of *leads*."""
    _clean(leads).write.json(path)


def json_array_lines(leads: DataFrame) -> DataFrame:
    """``record``: the lines of one JSON array, best lead first; *leads* (with unique ``seq``) are read twice.

    The first line opens the array, the others begin with a comma, and the last one closes it. Which ones these are
    follows from the least and the greatest place, so the lines can be written in parallel.
    """
    place = F.struct((-F.col("score")).alias("best"), "seq")
    ends = leads.agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first, last = (ends.select(c).scalar() for c in ("first", "last"))
    text = F.to_json(F.struct(*[c for c in EXPORT_COLUMNS]))
    line = F.concat(F.when(place == first, "[").otherwise(","), text, F.when(place == last, "]").otherwise(""))
    listed = leads.withColumn("sources", F.when(F.size("sources") > 0, F.col("sources")))
    return ranked(listed).select(line.alias("record"))


def write_json_array(leads: DataFrame, path: str) -> None:
    """Text files that form one JSON array when put together in the order of their names; ``[]`` for no leads."""
    spark = leads.sparkSession
    lines = json_array_lines(leads)
    (spark.createDataFrame([("[]",)], "record string") if leads.isEmpty() else lines).write.text(path)


def list_text(items: Column) -> Column:
    """A list as ``['a', 'b']``."""
    joined = F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))
    return F.when(F.size(items) > 0, joined).otherwise("[]")


def csv_columns(leads: DataFrame) -> DataFrame:
    first, *rest = EXPORT_COLUMNS
    return leads.select(
        F.col(first).alias(_BOM + first),
        *[list_text(F.col(c)).alias(c) if c == "sources" else c for c in rest],
    )


def write_csv(leads: DataFrame, path: str) -> None:
    """CSV with header and byte-order mark per file."""
    (
        csv_columns(leads).write.option("header", True).option("escape", '"').option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def export(leads: DataFrame, path: str, output_format: str = "both") -> list[str]:
    """Write the chosen formats and return their paths; nothing is written for no leads."""
    if leads.isEmpty():
        return []
    paths = []
    chosen = {"both": ("json", "csv")}.get(output_format.lower(), (output_format.lower(),))
    for name, write in (("json", write_json), ("json_array", write_json_array), ("csv", write_csv)):
        if name in chosen:
            ending = name.removesuffix("_array")
            write(leads, f"{path}.{ending}")
            paths.append(f"{path}.{ending}")
    return paths


def summary(leads: DataFrame, most: int = MAX_SCORE) -> DataFrame:
    """Numbered listing, best first, with scores out of *most*. Numbers come from bucket totals, not from one sorted task."""
    order = numbered(leads, ["score"], "seq", "number", across=[F.desc("score")])
    snippet = F.rtrim(F.substring("description", 1, SUMMARY_LENGTH))
    return order.select(
        "number", "company_name", F.concat(F.lit("["), F.col("score"), F.lit(f"/{most}]")).alias("score_tag"),
        F.concat_ws(", ", "sources").alias("sources_tag"), "website", "email", "address", "contact_page",
        F.when(F.length("description") > SUMMARY_LENGTH, F.concat(snippet, F.lit("…"))).otherwise(snippet).alias("snippet"),
    ).orderBy("number")
