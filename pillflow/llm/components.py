"""Connected components of links between documents, as joins and aggregates over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pillflow.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (the lowest node of its component) for every node of ``edges`` (``a``, ``b``).

    Large and small stars in turn: every node hands its neighbours the lowest node it knows, until each hangs from
    the lowest of its component. Minima are summed up before the shuffle, so a node with very many links does no harm.
    """
    now = stored(_directed(edges), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = _directed(both.join(lowest, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = stored(_directed(small), "edges")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    labels = now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from the higher node ``u`` to the lower ``v``."""
    return edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total).first())
