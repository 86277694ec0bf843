"""Exact search for the highest inner products with a KD-tree per shard.

Each shard is split at medians of its widest component down to leaves of ``LEAF`` vectors; every node keeps a tight
box around its vectors. A query goes through a tree best node first: a box bounds the inner product from above, and a
node whose bound is below the query's k-th best score so far is left out with all that is under it. Every query is
first answered in one shard; the k-th score found there goes along to all other shards, so that they start with it.

Scores are whole numbers. Ties go to the smaller ``vec_id``; so a node is left out only if its bound is strictly below.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pillflow.llm.common import stored
from pillflow.llm.vectors import PER_PART, PER_SHARD, deal, matrix, meet

LEAF = 128
_FOUND = "query_id long, vec_id long, score long"
_EXACT = float(1 << 53)


@dataclass
class Tree:
    """Vectors in the order of leaves; for each node its box, its rows, and the number of its first child or -1."""

    ids: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    span: np.ndarray
    child: np.ndarray


def build(ids: np.ndarray, rows: np.ndarray) -> Tree:
    order = np.arange(len(rows))
    spans, children, low, high = [(0, len(rows))], [-1], [], []
    at = 0
    while at < len(spans):
        a, b = spans[at]
        part = rows[order[a:b]]
        low.append(part.min(axis=0))
        high.append(part.max(axis=0))
        width = high[-1] - low[-1]
        axis = int(width.argmax()) if len(width) else 0
        if b - a > LEAF and len(width) and width[axis] > 0:
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], middle)]
            children[at] = len(spans)
            spans += [(a, a + middle), (a + middle, b)]
            children += [-1, -1]
        at += 1
    return Tree(ids[order], rows[order], np.array(low), np.array(high), np.array(spans), np.array(children))


def _products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles, as Python or 64-bit integers."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    if np.abs(rows).max() * np.abs(query).max() * rows.shape[1] < _EXACT:
        return (rows @ query).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(rows) @ whole(query)


def search(tree: Tree, query_id: int, query: np.ndarray, k: int, least: int | None, bounds: np.ndarray) -> list[tuple[int, int]]:
    """Up to ``k`` (score, vec_id), best first, none below ``least``; ``bounds`` holds the query's bound for each node."""
    best: list[tuple[int, int]] = []  # a heap, the worst on top; ids negative, so that larger ones are worse
    reach = -np.inf if least is None else least
    open_ = [(-bounds[0], 0)]
    while open_:
        bound, node = heapq.heappop(open_)
        if -bound < reach:
            break
        child = tree.child[node]
        if child >= 0:
            for c in (child, child + 1):
                if bounds[c] >= reach:
                    heapq.heappush(open_, (-bounds[c], c))
            continue
        a, b = tree.span[node]
        scores = _products(tree.rows[a:b], query)
        for i in np.flatnonzero(scores >= reach).tolist():
            if tree.ids[a + i] == query_id:
                continue
            entry = (int(scores[i]), -int(tree.ids[a + i]))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
            if len(best) == k:
                reach = max(reach, best[0][0])
    return [(score, -minus) for score, minus in sorted(best, reverse=True)]


def _search_shard(k: int):
    def one(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(shard):
            width = max(max(map(len, queries["vec"])), max(map(len, shard["vec"])))
            tree = build(shard["vec_id"].to_numpy(np.int64), matrix(shard["vec"], width))
            asked = matrix(queries["vec"], width)
            # A bound may be off by rounding where numbers are huge; it is then raised a little.
            bounds = np.maximum(asked, 0) @ tree.high.T + np.minimum(asked, 0) @ tree.low.T
            bounds += np.where(np.abs(bounds) < _EXACT / 64, 0, np.abs(bounds) * 1e-9)
            for i, (query_id, least) in enumerate(zip(queries["query_id"].tolist(), queries["least"].tolist())):
                known = None if least is None or least != least else int(least)
                found += [(query_id, v, s) for s, v in search(tree, query_id, asked[i], k, known, bounds[i])]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return one


def top_products(vectors: DataFrame, queries: DataFrame, k: int, per_shard: int = PER_SHARD) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` highest inner products of each query.

    ``vectors`` and ``queries`` have ``vec_id`` and ``vec``, arrays of whole numbers; a query is not its own answer.
    """
    shards, number = deal(vectors, "shard", per_shard)
    shards = stored(shards, "kd-shards")
    asked, parts = deal(queries.select(F.col("vec_id").alias("query_id"), "vec"), "part", PER_PART, "query_id")
    asked = stored(asked, "kd-queries")
    home = F.pmod(F.col("part"), F.lit(number))
    none = F.lit(None).cast("long")
    first = stored(meet(asked.withColumn("least", none), shards, F.array(home.cast("int")), parts, _search_shard(k), _FOUND), "kd-first")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    told = asked.join(kth.select("query_id", F.col("kth").alias("least")), "query_id", "left")
    others = F.filter(F.sequence(F.lit(0), F.lit(number - 1)), lambda s: s != home)
    rest = meet(told, shards, others, parts, _search_shard(k), _FOUND)
    # At most k rows of each query and shard, and only those that reach its k-th score.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
