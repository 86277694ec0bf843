"""Vectors as rows of numbers, dealt to shards and to parts of queries, for searches of shard after shard."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors in a shard and queries in a part, on average; a task holds one of each.
PER_SHARD = 8_192
PER_PART = 1_024


def usable(vector: str | Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``vec`` (doubles); a repeated ``vec_id`` counts once, a null one not at all."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & usable("vec")).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def deal(rows: DataFrame, column: str, per: int, key: str = "vec_id") -> tuple[DataFrame, int]:
    """``rows`` with ``column`` from 0 on by a hash of ``key``, and the number of values."""
    count = max(1, -(-rows.count() // per))
    return rows.withColumn(column, F.pmod(F.xxhash64(F.lit(column), key), F.lit(count)).cast("int")), count


def meet(queries: DataFrame, shards: DataFrame, pairs: Column, parts: int,
         search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``search(queries of a part, rows of a shard)`` for each pair of a part and a shard.

    ``queries`` have ``part``, ``shards`` have ``shard``; ``pairs`` gives the shards a row of ``queries`` visits.
    """
    visits = queries.withColumn("shard", F.explode(pairs))
    copies = shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search(left, right)

    return visits.groupBy("part", "shard").cogroup(copies.groupBy("part", "shard")).applyInPandas(both, schema)


def matrix(vectors: pd.Series, width: int = 0) -> np.ndarray:
    """Rows of a column of arrays; shorter ones are filled with zeros."""
    width = max([width, *(len(v) for v in vectors)])
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out
