"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a hash string of 64 bits, the signs of random projections, and keeps the strings in
a sorted array, so all vectors that share a prefix stand together. A search finds a query's place in every tree
and descends to its longest prefix match; then all trees ascend together, shortening the prefix by one bit,
until they hold ``candidates`` entries between them. These are compared by cosine in double precision.

Vectors are dealt to shards of bounded size, and each shard has a forest of its own. Queries, a stated set, pass
through each shard in batches; a shard returns its nearest few for each query, and the best
of all shards remain. A shard's share of entries that are compared depends on the shard's size alone, so recall
does not change with the number of shards.

Of equal vectors only the k + 1 with the smallest ids are indexed: no other can be among any query's k nearest.
Vectors that are null, of another length than most, zero, or hold null or non-finite numbers take no part. Ties go to the
smaller id. With no more than k candidates, all are returned. Rows that repeat an id and its vector count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

TREES, LEVELS, SEED = 48, 20, 5
SHARD_ROWS = 8192
#: Entries gathered over all trees before duplicates go, as a multiple of the shard's rows.
GATHER = 1.0


def projections(dimensions: int, trees: int = TREES) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimensions, trees * LEVELS)).astype(np.float32)


def strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Hash strings, by tree and vector, the first bit the most significant."""
    bits = (vectors.astype(np.float32) @ planes > 0).reshape(len(vectors), -1, LEVELS)
    weights = np.uint32(1) << np.arange(LEVELS - 1, -1, -1, dtype=np.uint32)
    return np.ascontiguousarray((bits * weights).sum(axis=2, dtype=np.uint32).T)


class Forest:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES):
        self.ids = ids
        self.units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.planes = projections(vectors.shape[1], trees)
        hashes = strings(self.units, self.planes)
        self.order = np.argsort(hashes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(hashes, self.order, axis=1)

    def spans(self, hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries that share ``level`` bits with each query stand, by tree and query."""
        low = (hashes >> np.uint32(LEVELS - level)) << np.uint32(LEVELS - level)
        high = low | np.uint32((1 << (LEVELS - level)) - 1)
        lo, hi = np.empty(hashes.shape, dtype=np.int64), np.empty(hashes.shape, dtype=np.int64)
        for t, own in enumerate(self.sorted):
            lo[t], hi[t] = np.searchsorted(own, low[t], "left"), np.searchsorted(own, high[t], "right")
        return lo, hi

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, candidates: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, cosines) of the nearest found, nearest first."""
        queries = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        hashes = strings(queries, self.planes)
        waiting = np.ones(len(queries), dtype=bool)
        lo, hi = np.zeros(hashes.shape, dtype=np.int64), np.zeros(hashes.shape, dtype=np.int64)
        for level in range(LEVELS, -1, -1):
            at = np.flatnonzero(waiting)
            if not len(at):
                break
            lo[:, at], hi[:, at] = self.spans(hashes[:, at], level)
            waiting[at] = (hi[:, at] - lo[:, at]).sum(axis=0) < candidates
        for i, q in enumerate(queries):
            near = np.zeros(len(self.ids), dtype=bool)
            for t in range(len(self.order)):
                near[self.order[t, lo[t, i] : hi[t, i]]] = True
            near = np.flatnonzero(near)
            near = near[self.ids[near] != query_ids[i]]
            score = np.einsum("ij,j->i", self.units[near], q)
            best = np.lexsort((self.ids[near], -score))[:k]
            yield int(query_ids[i]), self.ids[near[best]], score[best]


def _usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


def _deal(k: int, candidates: float, trees: int):
    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, ids, rows, forest = None, [], [], None
        for part in parts:
            for value, own in part.groupby("shard", sort=False):
                if value != shard:
                    shard, ids, rows, forest = value, [], [], None
                index = own[~own["asks"]]
                if len(index):
                    ids.append(index["vec_id"].to_numpy())
                    rows.append(np.stack(index["v"].to_list()))
                asks = own[own["asks"]]
                if not len(asks) or not ids:
                    continue
                if forest is None:
                    forest = Forest(np.concatenate(ids), np.concatenate(rows), trees)
                want = max(64, int(candidates * len(forest.ids)))
                for q, near, score in forest.search(asks["vec_id"].to_numpy(), np.stack(asks["v"].to_list()), k, want):
                    yield pd.DataFrame({"query_id": q, "vec_id": near, "score": score})

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", trees: int = TREES, candidates: float = GATHER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest of all vectors but its own."""
    ship(vectors.sparkSession)
    usable, asked = _usable(vectors, vec_id, vector), _usable(queries, vec_id, vector)
    sizes = usable.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    width = sizes[0].n if sizes else 0
    fits = F.size("v") == width
    # the row number is cut in each task before the shuffle, so a very common vector is a few rows
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    index = usable.filter(fits).dropDuplicates(["vec_id", "v"]).withColumn("r", rank).filter(F.col("r") <= k + 1)
    shards = max(1, -(-(sizes[0].rows if sizes else 0) // shard_rows))
    dealt = index.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    asks = asked.filter(fits).dropDuplicates(["vec_id", "v"]).select(every, F.lit(True).alias("asks"), "vec_id", "v")
    both = dealt.unionByName(asks).repartition("shard").sortWithinPartitions("shard", "asks")
    found = both.mapInPandas(_deal(k, candidates, trees), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
