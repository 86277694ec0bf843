"""Numbering rows by a total order without gathering them in one task.

Rows are range partitioned by the order, so a hot key is cut at any point, and sorted in each partition.
The id Spark then gives holds the partition and the place in it; what is left is to add up the sizes of the
partitions before. The rows are checkpointed first, so that a lost executor cannot move the cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pillflow.session import keep

_PLACE_BITS = 33  # fixed by monotonically_increasing_id: the lower bits are the place in the partition


def sorted_slices(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` cut into ordered slices: ``_slice`` rises with the order, ``_place`` counts from 0 in each slice."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = keep(ordered.withColumn("_id", F.monotonically_increasing_id()))
    return stored.withColumns({
        "_slice": F.shiftright("_id", _PLACE_BITS),
        "_place": F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)),
    }).drop("_id")


def rank_rows(df: DataFrame, *order: str | Column, rank: str = "rang") -> DataFrame:
    """``df`` with the rank of each row, 1, 2, 3, ..., in the given total order."""
    return number_slices(sorted_slices(df, *order), rank)


def number_slices(slices: DataFrame, rank: str = "rang") -> DataFrame:
    """Ranks for rows that are in slices already."""
    # One row per partition of the shuffle: small whatever the data, so the running sum and the broadcast are safe.
    sizes = slices.groupBy("_slice").agg((F.max("_place") + 1).alias("_size"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return (
        slices.join(F.broadcast(starts), "_slice")
        .withColumn(rank, F.col("_start") + F.col("_place") + 1)
        .drop("_slice", "_place", "_start")
    )


def free_numbers(occupied: DataFrame, needed: int, first: int = 1) -> DataFrame:
    """The ``needed`` lowest numbers from ``first`` on that are not in the one column of ``occupied``.

    Result: ``rang`` 1..needed and ``nummer``.
    """
    spark = occupied.sparkSession
    taken = occupied.toDF("nummer").where(F.col("nummer") >= first).distinct()
    candidates = spark.range(first, first + needed + taken.count()).toDF("nummer")
    ranked = rank_rows(candidates.join(taken, "nummer", "left_anti"), "nummer")
    return ranked.where(F.col("rang") <= needed).select("rang", "nummer")


def take_lowest(needs: DataFrame, numbers: DataFrame) -> DataFrame:
    """Hand out numbers that become free in the course of time: each need takes the lowest that is free just then.

    ``needs`` has ``at`` (unique), ``numbers`` has ``nummer`` (unique) and ``since``; a number that comes free at the
    time of a need is too late for it. There must be a free number for every need. Result: ``at``, ``nummer``.

    Numbers are halved by size, all at once and again and again: a need is served by the lower half if that is not
    used up when its turn comes. Counting numbers up and needs down, in order of time, it is used up for just those needs
    that bring the count to a new low below zero. So each halving is one sort and a running sum over slices, and
    twenty of them settle a million numbers, whatever the order of events.
    """
    ranked = rank_rows(numbers.select("nummer", "since"), "nummer").withColumn("rang", F.col("rang") - 1)
    events = keep(needs.select("at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("nummer"), F.lit(0).cast("long").alias("rang"))
                  .unionByName(ranked.select(F.col("since").alias("at"), F.lit(1).alias("kind"), "nummer", "rang"))
                  .withColumn("node", F.lit(0).cast("long")))
    bits = max(0, events.where("kind = 1").count() - 1).bit_length()
    for bit in reversed(range(bits)):
        events = _halved(events, bit)
    served = events.where("kind = 0").select("at", "node")
    return served.join(events.where("kind = 1").select("nummer", "node"), "node").select("at", "nummer")


def _halved(events: DataFrame, bit: int) -> DataFrame:
    """``events`` with the lower or the higher half of each ``node`` in place of the node."""
    upper = F.shiftright("rang", bit).bitwiseAND(F.lit(1))
    is_number = F.col("kind") == 1
    slices = sorted_slices(events, "node", "at", "kind", "rang").withColumn(
        "_step", F.when(~is_number, -1).when(upper == 0, 1).otherwise(0))
    here = Window.partitionBy("_slice", "node").orderBy("_place")
    summed = slices.withColumn("_sum", F.sum("_step").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    summed = summed.withColumn("_low", F.min("_sum").over(here.rowsBetween(Window.unboundedPreceding, -1)))
    # A node may go on over several slices: what the slices before it bring along.
    parts = summed.groupBy("node", "_slice").agg(F.sum("_step").alias("_total"), F.min("_sum").alias("_least"))
    earlier = Window.partitionBy("node").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    parts = parts.withColumn("_floor", F.least(F.lit(0), F.min(F.col("_base") + F.col("_least")).over(earlier)))
    brought = summed.join(parts.select("node", "_slice", "_base", "_floor"), ["node", "_slice"])
    low = F.least("_floor", F.col("_base") + F.col("_low"))
    half = F.when(is_number, upper).otherwise((F.col("_base") + F.col("_sum") < low).cast("long"))
    return brought.select("at", "kind", "nummer", "rang", (F.col("node") * 2 + half).alias("node"))
