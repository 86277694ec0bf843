"""Approximate nearest neighbours by collision counting.

Each vector is projected on ``LINES`` random lines; the index of a shard holds the projections of its vectors line by
line. Around the query's own projection on each line a window is opened and widened level by level, which takes the
place of hashing anew with wider buckets. A vector collides with the query on a line once it lies in the window there.
As collisions only grow with the level, the search begins at the level where the query before ended. Vectors that collide on ``THRESHOLD`` of the lines are verified: their
true distance is computed in double precision on the original vectors. A shard is done when it has verified its share.

Every vector is indexed and every query visits every shard, so only vectors that collide too rarely can be missed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pillflow.llm.common import stored
from pillflow.llm.vectors import PER_PART, PER_SHARD, deal, matrix, meet

LINES = 128
#: Share of the lines on which a vector must collide to be verified.
THRESHOLD = 0.5
#: Widening stops once this share of a shard, and at least this many vectors, are verified.
VERIFIED, LEAST = 0.3, 600
#: First half width of the windows, as a share of the spread of projections, and the factor of each level.
START, WIDER = 0.25, 1.15
SEED = 417

_FOUND = "query_id long, vec_id long, score double"


class LineIndex:
    """The projections of one shard."""

    def __init__(self, rows: np.ndarray):
        self.lines = np.random.default_rng(SEED).standard_normal((rows.shape[1], LINES))
        projected = rows @ self.lines
        self.spread = float(projected.std()) or 1.0
        self.projected = np.ascontiguousarray(projected.T, np.float32)
        self.count = len(rows)
        self.level = 0
        self.apart = np.empty_like(self.projected)  # room to work in
        self.inside = np.empty(self.projected.shape, bool)

    def candidates(self, query: np.ndarray, wanted: int) -> np.ndarray:
        """Rows that collide on enough lines, when at least ``wanted`` do."""
        if wanted >= self.count:
            return np.arange(self.count)
        at = (query @ self.lines).astype(np.float32)
        np.abs(np.subtract(self.projected, at[:, None], out=self.apart), out=self.apart)
        found = self._colliding(self.level)
        if len(found) < wanted:
            while len(found) < wanted:
                self.level += 1
                found = self._colliding(self.level)
            return found
        while self.level > 0 and len(fewer := self._colliding(self.level - 1)) >= wanted:
            self.level, found = self.level - 1, fewer
        return found

    def _colliding(self, level: int) -> np.ndarray:
        """Rows in the windows of a level on enough lines."""
        np.less_equal(self.apart, np.float32(START * self.spread * WIDER**level), out=self.inside)
        collisions = np.add.reduce(self.inside.view(np.uint8), axis=0, dtype=np.uint8)
        return np.flatnonzero(collisions >= math.ceil(THRESHOLD * LINES))


def _search_shard(k: int):
    def one(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(shard):
            width = max(max(map(len, queries["vec"])), max(map(len, shard["vec"])))
            rows, ids = matrix(shard["vec"], width), shard["vec_id"].to_numpy(np.int64)
            asked = matrix(queries["vec"], width)
            index = LineIndex(rows)
            wanted = max(LEAST, int(np.ceil(VERIFIED * len(rows))))
            for query_id, query in zip(queries["query_id"].tolist(), asked):
                near = index.candidates(query, wanted)
                near = near[ids[near] != query_id]
                distance = np.sqrt(((rows[near] - query) ** 2).sum(axis=1))
                if len(near) > k:  # ties with the kth stay for the order by number
                    close = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
                    near, distance = near[close], distance[close]
                best = np.lexsort((ids[near], distance))[:k]
                found += [(query_id, int(ids[near[i]]), float(distance[i])) for i in best]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return one


def nearest(vectors: DataFrame, queries: DataFrame, k: int, per_shard: int = PER_SHARD) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found by Euclidean distance, ties to the smaller id.

    ``vectors`` and ``queries`` have ``vec_id`` and ``vec``; a query is not its own answer.
    """
    shards, number = deal(vectors, "shard", per_shard)
    shards = stored(shards, "line-shards")
    asked, parts = deal(queries.select(F.col("vec_id").alias("query_id"), "vec"), "part", PER_PART, "query_id")
    asked = stored(asked, "line-queries")
    every = F.sequence(F.lit(0), F.lit(number - 1))
    found = meet(asked, shards, every, parts, _search_shard(k), _FOUND)
    # At most k rows of each query and shard.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
