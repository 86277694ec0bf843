"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash and ranked; a row's fractional rank is its place in its
source, as a share of the source. Sorted by it, every stretch of rows holds the sources in the proportions of the
whole, and cutting the sorted rows into equal counts gives shards that match the mixture.

Ranks come from range partitions of the whole order, so that a source with a third of all rows is cut among tasks.
Empty tables give no rows; a null source is a source of its own; repeated rows are placed one by one; a null text
counts as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pillflow.operators.ranking import rank_rows


def interleave(rows: DataFrame, shards: int, source: str, unique: list[str | Column], seed: int = 0) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (its place in the shard, from 0).

    ``unique`` are columns that tell rows apart; rows equal in all of them may change places. Rows per shard differ
    by one at most.
    """
    mixed = rows.withColumns({
        "_source": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")),
        "_mix": F.xxhash64(F.lit(seed), *unique),
    })
    order = ["_mix", *unique]
    ranked = rank_rows(mixed, "_source", *order, rank="_rank")
    # One row per source; the join is left to Spark, which broadcasts it only where it is small and else splits
    # a source that fills a partition.
    sources = ranked.groupBy("_source").agg(F.min("_rank").alias("_first"), F.count("*").alias("_count"))
    facts = sources.withColumn("_key", F.concat("_source", F.lit("#"))).drop("_source")
    share = (F.col("_rank") - F.col("_first") + 0.5) / F.col("_count")
    placed = ranked.withColumn("_key", F.concat("_source", F.lit("#"))).join(facts, "_key").withColumn("_share", share)
    # Ties between sources of one size are settled by the hash.
    sorted_rows = rank_rows(placed.drop("_key", "_first", "_count", "_rank"), "_share", *order, rank="_rank")
    total = sorted_rows.agg(F.count("*").alias("_total"))
    place = F.col("_rank") - 1
    cut = sorted_rows.crossJoin(F.broadcast(total))  # one row: the number of all rows
    # Shard s begins at ceil(s * total / shards).
    shard = F.expr(f"(_rank - 1) * {shards} div _total")
    start = F.expr(f"((_shard * _total) + {shards - 1}) div {shards}")
    return cut.withColumn("_shard", shard).withColumns({
        "shard": F.col("_shard").cast("int"), "slot": (place - start).cast("long"),
    }).drop("_source", "_mix", "_share", "_rank", "_total", "_shard")
