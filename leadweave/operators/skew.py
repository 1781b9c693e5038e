"""Joins and numbering that keep a hot group spread over many tasks."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from leadweave.session import fan_out, settle

_HOT_ROWS_SETTING = "leadweave.skew.hotRows"
_HOT_ROWS_DEFAULT = "100000"
# A key counts as hot from this part of a shuffle partition's fair share of the rows on.
_HOT_SHARE = 0.25


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys that would weigh on a partition; by share of the rows, so there are only a few per partition.

    Counts combine before the shuffle. *df* is read twice more for this: pass a settled frame or a
    cheap one.
    """
    spark = df.sparkSession
    hot_rows = int(spark.conf.get(_HOT_ROWS_SETTING, _HOT_ROWS_DEFAULT))
    keyed = df.where(F.col(key).isNotNull())
    share = keyed.agg((F.count("*") * _HOT_SHARE / fan_out(spark)).alias("share")).scalar()
    return keyed.groupBy(key).count().where((F.col("count") >= hot_rows) & (F.col("count") >= share)).select(key)


def hot_keys_of(df: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """:func:`hot_keys` of several columns, counted in one pass over *df* and written."""
    spark = df.sparkSession
    hot_rows = int(spark.conf.get(_HOT_ROWS_SETTING, _HOT_ROWS_DEFAULT))
    named = F.array(*[F.struct(F.lit(k).alias("column"), F.col(k).cast("string").alias("key")) for k in keys])
    counts = df.select(F.inline(named)).where("key is not null").groupBy("column", "key").count()
    share = F.sum("count").over(Window.partitionBy("column")) * _HOT_SHARE / fan_out(spark)
    # Keys below the absolute size go before the window, but for one row with their sum.
    kept = counts.groupBy("column", F.when(F.col("count") >= hot_rows, F.col("key")).alias("key")).agg(F.sum("count").alias("count"))
    hot = settle(kept.withColumn("share", share).where((F.col("count") >= F.col("share")) & F.col("key").isNotNull()))
    return {k: hot.where(F.col("column") == k).select(F.col("key").cast(df.schema[k].dataType).alias(k)) for k in keys}


def skew_join(
    left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "left", hot: DataFrame | None = None
) -> DataFrame:
    """Join on *key*, unique in *right*, with the hot keys of *left* spread over salts.

    *spread* is a column that varies within a key. Rows without key are spread as well. *hot* is
    for a *left* that is costly to read twice: its hot keys, counted on an earlier frame.
    """
    salts = fan_out(left.sparkSession)
    hot = hot_keys(left, key) if hot is None else hot
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    drawn = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    salted = left.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot") | F.col(key).isNull(), drawn).otherwise(0)
    ).drop("_hot")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    copied = right.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return salted.join(copied, [key, "_salt"], how).drop("_salt")


def spread_min(df: DataFrame, key: str, spread: str, value: str, out: str) -> DataFrame:
    """Add the least *value* of each *key*; a hot key's rows stay apart by salt.

    Only one row per key and salt meets in the second step. Both steps read the same shuffle, which
    is why the salt cannot be null and rows without key are left out at once.
    """
    drawn = F.pmod(F.xxhash64(spread), F.lit(fan_out(df.sparkSession)))
    salted = df.where(F.col(key).isNotNull()).withColumn("_salt", F.coalesce(drawn.cast("int"), F.lit(0)))
    salted = salted.repartition(key, "_salt")
    least = salted.groupBy(key, "_salt").agg(F.min(value).alias(out))
    least = least.withColumn(out, F.min(out).over(Window.partitionBy(key)))
    return salted.join(least, [key, "_salt"]).drop("_salt")


def with_bucket(df: DataFrame, order: str, out: str = "_bucket") -> DataFrame:
    """Add a bucket number that rises with *order*, each bucket with about the same row count.

    The bounds are quantiles: the driver receives one number per bucket and no rows.
    """
    parts = fan_out(df.sparkSession)
    shares = [i / parts for i in range(1, parts)]
    bounds = df.agg(F.percentile_approx(order, shares, parts * 20)).first()[0] or []
    splits = [float("-inf"), *sorted({float(b) for b in bounds}), float("inf")]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0))
    bucketed = Bucketizer(splits=splits, inputCol=order, outputCol=out).transform(df)
    return bucketed.withColumn(out, F.col(out).cast("int"))


def numbered(df: DataFrame, groups: list[str], order: str, out: str, across: list[Column] | None = None) -> DataFrame:
    """Add the 1-based position by *order* within *groups*, for groups of any size.

    Rows are numbered within buckets of *order*; the bucket totals, few per group, give the start
    of each bucket. With *across*, groups follow one another in that order and numbers run on.
    """
    bucketed = with_bucket(df, order)
    cell = [*groups, "_bucket"]
    totals = bucketed.groupBy(*cell).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*groups).orderBy("_bucket") if across is None else Window.orderBy(*across, "_bucket")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*cell, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*cell).orderBy(order)
    return (
        bucketed.join(starts, cell)
        .withColumn("_place", F.row_number().over(within))
        .withColumn(out, F.col("_start") + F.col("_place"))
        .drop("_bucket", "_start", "_place")
    )


def ranked_by_page(df: DataFrame, groups: list[str], page: str, order: str, out: str) -> DataFrame:
    """Add the 1-based position within *groups* by *order*, which sorts by the number *page* first.

    A page's rows are few and are sorted alone; how many rows lie before a page comes from the totals of ranges of
    pages. The page numbers themselves may be of any size and need not be dense. *df* is read twice.
    """
    totals = df.groupBy(*groups, page).agg(F.count("*").alias("_rows"))
    ranged = settle(with_bucket(totals, page))
    cells = ranged.groupBy(*groups, "_bucket").agg(F.sum("_rows").alias("_cell"))
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*groups, "_bucket", F.coalesce(F.sum("_cell").over(earlier), F.lit(0)).alias("_cell_start"))
    within = Window.partitionBy(*groups, "_bucket").orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.withColumn("_start", F.coalesce(F.sum("_rows").over(within), F.lit(0))).join(cells, [*groups, "_bucket"])
    starts = starts.select(*groups, page, (F.col("_start") + F.col("_cell_start")).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*groups, page).orderBy(order))
    return df.withColumn("_place", place).join(starts, [*groups, page]).withColumn(out, F.col("_start") + F.col("_place")).drop("_start", "_place")


def first_per_group(df: DataFrame, groups: list[str], order: str | list[str], n: int, out: str = "rank") -> DataFrame:
    """The first *n* rows of each group by *order*, with their position; one plan for any *n* and any group.

    Lists of at most *n* rows are merged like sums: every task keeps the first *n* of each group that it reads, the
    rows left are dealt to salts within their group and cut again, and only the first *n* of each salt meet.
    Each cut sorts on disk where it must, so *n* is not bounded by memory.
    """
    keys = [order] if isinstance(order, str) else order
    last = [F.col(c).asc() for c in keys]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(fan_out(df.sparkSession))))
    # Spark cuts the rows of a task by this limit before they are shuffled.
    part = F.row_number().over(Window.partitionBy(*groups, "_salt").orderBy(*last))
    some = salted.withColumn("_part", part).where(F.col("_part") <= n).drop("_part", "_salt")
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*last))
    return some.withColumn(out, rank).where(F.col(out) <= n).withColumn(out, F.col(out).cast("long"))
