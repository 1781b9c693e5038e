"""Mixing sources to target weights, as a curriculum whose weights vary over training.

Every source has a weight schedule over training time 0 to 1, piecewise linear between knots. Its
integral is the source's weight, and the targets share the budget by weight, no source above
``most`` times its size. The integral up to a time, scaled to the target, is the cumulative
demand of words; inverting it gives the time at which the source's next word is due. So the
documents of a source, in a keyed random order and repeated in passes until the target is met,
each get a training position, and sorting all of them by range of position is the training order.

Only DataFrame functions are used. The one table that is not spread is the list of sources.

Defined cases: a null text has size 0; documents of size 0 are never taken; null is a source of
its own, last in order; repeated rows count each; an empty table gives no rows. Other columns of
the input, also of the names used here, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadweave.llm.common import n_words, spread, whole_text
from leadweave.session import settle

Knots = Sequence[tuple[float, float]]

# By turns over the sources in order; the integrals over 0 to 1 are the weights 3, 1 and 2. The first
# rises over training, the second fades, the third peaks in the middle.
SCHEDULES: tuple[Knots, ...] = (
    ((0.0, 2.0), (1.0, 4.0)),
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (0.5, 3.0), (1.0, 1.0)),
)


def integral(knots: Knots) -> float:
    """The weight of a schedule: its integral over training time."""
    return sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(knots, knots[1:]))


def _time_of(share: Column, knots: Knots) -> Column:
    """The time at which a share (0 to 1) of the schedule's integral is reached."""
    whole, before, time = integral(knots), 0.0, None
    pieces = []
    for (a, u), (b, v) in zip(knots, knots[1:]):
        area, slope = (b - a) * (u + v) / 2, (v - u) / (b - a)
        rest = F.greatest(share * whole - before, F.lit(0.0))
        # The root of slope/2 x^2 + u x = rest, in the form that is stable for slopes near zero.
        root = F.sqrt(F.greatest(F.lit(u * u) + 2 * slope * rest, F.lit(0.0))) + u
        step = F.when(root > 0, 2 * rest / root).otherwise(F.lit(0.0))
        before += area
        pieces.append((before / whole, F.least(F.lit(a) + step, F.lit(b))))
    for upto, piece in reversed(pieces):
        time = piece if time is None else F.when(share <= upto, piece).otherwise(time)
    return time


def source_targets(
    sizes: DataFrame, schedules: Sequence[Knots] = SCHEDULES, budget: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``source, source_size, slot, target`` from ``source, size`` rows.

    A source whose share by weight exceeds ``most`` times its size stops there. Sorted by
    the level at which each source stops, the level that spends the whole budget is the first that
    the next source still allows, so no rounds are needed.
    """
    weights = F.array(*[F.lit(integral(k)) for k in schedules])
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    slots = totals.withColumn("slot", (F.row_number().over(by_name) - 1) % len(schedules))
    weighed = slots.withColumn("weight", F.get(weights, F.col("slot"))).withColumn(
        "stop", F.col("source_size") * most / F.col("weight")
    )
    by_stop = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before, everything = by_stop.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    # If this source and all that stop later share what the earlier ones leave, the level is this:
    level = (
        F.sum("source_size").over(everything) * F.lit(budget)
        - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(most)
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = weighed.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(everything)["level"]
    share = F.least(F.col("source_size") * F.lit(most), F.col("weight") * F.col("shared"))
    return leveled.withColumn("shared", F.coalesce(first, F.lit(float("inf")))).select(
        "source", "source_size", "slot", F.when(F.col("source_size") > 0, share).otherwise(F.lit(0.0)).alias("target")
    )


def curriculum(
    documents: DataFrame,
    schedules: Sequence[Knots] = SCHEDULES,
    budget: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies``.

    ``copies`` lists the passes in which the document is taken: ``pass, position`` (training time
    at which its middle word is due) and ``words`` (all of its words, or those up to the target for the
    document at which the source's demand ends).
    """
    spark = documents.sparkSession
    # The order within a source is by a keyed hash, cut into ranges of the hash: a source of any size
    # spreads over all ranges, and one row per range carries the running total.
    parts = spread(spark)
    sized = settle(documents.select("doc_id", "source", n_words(whole_text()).alias("size"), _key(seed).alias("key"), _key(seed + 1).alias("twin")))
    cut = sized.withColumn("part", F.floor((F.shiftrightunsigned("key", 32) * parts) / F.lit(1 << 32)).cast("int"))
    cells = cut.groupBy("source", "part").agg(F.sum("size").alias("cell_size"))
    targets = source_targets(cells.withColumnRenamed("cell_size", "size"), schedules, budget, most)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(
        F.col("source").alias("of"), "part", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)).alias("start")
    ).join(targets.withColumnRenamed("source", "name"), F.col("of").eqNullSafe(F.col("name"))).drop("name")
    starts = starts.withColumnRenamed("part", "of_part")
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = cut.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))
    )
    begin, words = F.col("start") + F.col("ahead"), F.round("target").cast("long")
    passes = F.sequence(F.lit(0), F.lit(int(most) + (most > int(most)) - 1))
    middle = lambda p: (begin + p * F.col("source_size") + F.col("size") / 2) / F.nullif("target", F.lit(0.0))

    def copy(p: Column) -> Column:
        due, time = F.least(middle(p), F.lit(1.0)), None
        for slot, knots in enumerate(schedules):
            piece = _time_of(due, knots)
            time = piece if time is None else F.when(F.col("slot") == slot, piece).otherwise(time)
        left = words - begin - p * F.col("source_size")
        return F.struct(
            p.alias("pass"), time.alias("position"),
            F.greatest(F.least(F.col("size"), left), F.lit(0)).cast("long").alias("words"),
        )

    taken = F.filter(F.transform(passes, copy), lambda c: c["words"] > 0)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("copies"), "key", "twin")


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "source", "text")


def mixed_documents(documents: DataFrame, seed: int = 7, **settings: object) -> DataFrame:
    """The rows of *documents*, as often as the mix takes them, in training order.

    Documents are taken whole: the one at which a source's demand ends is in if at least half of its words are.
    Rows that agree in id, source and text are repeats: each comes as often as it is taken, with the other
    columns of one of them.
    """
    plan = curriculum(documents, seed=seed, **settings)
    whole = F.filter("copies", lambda c: 2 * c["words"] >= F.col("size"))
    due = F.transform(whole, lambda c: c["position"])
    taken = plan.groupBy(F.col("key").alias("_key"), F.col("twin").alias("_twin")).agg(
        F.flatten(F.collect_list(due)).alias("_positions")
    ).where(F.size("_positions") > 0)
    given = documents.columns
    rows = documents.withColumns({"_key": _key(seed), "_twin": _key(seed + 1)}).join(taken, ["_key", "_twin"])
    repeat = F.row_number().over(Window.partitionBy("_key", "_twin").orderBy("_key"))
    once = rows.withColumn("_repeat", repeat).where("_repeat = 1")
    due_rows = once.select(*given, "_key", F.explode("_positions").alias("_position"))
    return due_rows.repartitionByRange("_position", "_key").sortWithinPartitions("_position", "_key").select(*given)


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per taken copy, sorted by training position over all partitions."""
    copies = mixed.select("*", F.explode("copies").alias("copy")).select(
        *[c for c in mixed.columns if c not in ("copies", "key", "twin")], "copy.pass", "copy.position", "copy.words"
    )
    ties = F.xxhash64("doc_id", "pass")
    return copies.repartitionByRange("position", ties).sortWithinPartitions("position", ties)
