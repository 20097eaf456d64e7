"""Nearest neighbours by collision-counting hashing.

Every hash function is one random projection, kept as a sorted array. Around a query's projection a window grows with the radius
(virtual rehashing: the arrays are never rebuilt), and a vector collides where it lies inside. At each radius R the
vectors whose collisions reach the threshold are verified on the original vectors; the threshold is such that a vector at
distance R misses it in about one case of forty. The search ends when the k-th verified distance is within the radius, or all are verified.

Vectors are dealt to blocks of bounded size, each with arrays of its own, and queries to blocks as well; every block of queries meets
every block of vectors of its dimension by an equality join, and the best of all blocks are ranked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: components in a block of vectors, and of queries
BLOCK, QUERY_BLOCK = 1 << 22, 1 << 20
#: stands for a missing id inside a task, and sorts last
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    """projections: hash functions; half: half width of a window for each unit of radius; growth: of the radius; deviations: by
    how many standard deviations the threshold is under the expected collisions at distance R."""

    projections: int = 96
    half: float = 1.0
    growth: float = 1.12
    deviations: float = 2.0
    seed: int = 7


class Block:
    """Vectors with one sorted array of projections per hash function."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, settings: Settings):
        self.ids, self.vectors, self.settings = ids, vectors, settings
        rng = np.random.default_rng(settings.seed)
        self.directions = rng.standard_normal((settings.projections, vectors.shape[1]))
        projected = self.directions @ vectors.T.astype(np.float64)
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        share = math.erf(settings.half / math.sqrt(2))
        m = settings.projections
        self.threshold = max(1, math.ceil(m * share - settings.deviations * math.sqrt(m * share * (1 - share))))

    def distances(self, query: np.ndarray, places: np.ndarray) -> np.ndarray:
        difference = self.vectors[places].astype(np.float64) - query
        return np.sqrt((difference * difference).sum(axis=1))

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(distance, id) of the k nearest found, nearest first, ties to the smaller id; the query's own id takes no part."""
        m, n = self.sorted.shape
        center = self.directions @ query
        low = np.array([np.searchsorted(row, c) for row, c in zip(self.sorted, center, strict=True)])
        high = low.copy()
        counts = np.zeros(n, np.int16)
        waiting = self.ids != query_id
        best_ids, best = np.empty(0, np.int64), np.empty(0)
        radius = self.first_radius(center, low)
        while waiting.any():
            for j in range(m):
                row, order = self.sorted[j], self.order[j]
                reach = self.settings.half * radius
                a, b = np.searchsorted(row, center[j] - reach), np.searchsorted(row, center[j] + reach, "right")
                if a < low[j]:
                    counts[order[a:low[j]]] += 1
                    low[j] = a
                if b > high[j]:
                    counts[order[high[j]:b]] += 1
                    high[j] = b
            places = np.flatnonzero(waiting & (counts >= self.threshold))
            if len(places):
                waiting[places] = False
                best = np.concatenate((best, self.distances(query, places)))
                best_ids = np.concatenate((best_ids, self.ids[places]))
                first = np.lexsort((best_ids, best))[:k]
                best, best_ids = best[first], best_ids[first]
            if len(best) == k and best[-1] <= radius:
                break
            radius *= self.settings.growth
        return list(zip(best.tolist(), best_ids.tolist(), strict=True))

    def first_radius(self, center: np.ndarray, at: np.ndarray) -> float:
        """Half the median distance, over the projections, to the nearest projection; at least a speck of the block's spread."""
        n = self.sorted.shape[1]
        rows = np.arange(len(center))
        nearest = np.minimum(np.abs(self.sorted[rows, np.minimum(at, n - 1)] - center), np.abs(self.sorted[rows, np.maximum(at - 1, 0)] - center))
        spread = float((self.sorted[:, -1] - self.sorted[:, 0]).max()) or 1.0
        return max(float(np.median(nearest)) / 2 / self.settings.half, spread * 1e-3)


def nearest(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """For every row of ``vectors`` where ``queries`` holds: query_id, rank (from 1), vec_id and score (Euclidean distance) of its ``k`` nearest found.

    Vectors that are null, zero or hold null or non-finite components take no part, and only vectors of one length are compared.
    Rows equal in id and vector count once; a candidate never has the query's id. A row without id is a candidate (its vec_id is
    null and sorts last) but no query. Fewer candidates than ``k`` give them all; an empty table gives none. Other columns are not read.
    """
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    known = (vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
             .where(F.col("v").isNotNull()).where(usable).distinct().withColumn("size", F.size("v")))
    sizes = known.groupBy("size").agg(
        F.ceil(F.count("*") * F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if("asks") * F.col("size") / QUERY_BLOCK).cast("int").alias("query_blocks"))
    dealt = known.join(sizes, "size").where("query_blocks > 0").withColumn("dealt", F.xxhash64("id", "v"))
    data = (dealt.withColumn("b", F.pmod("dealt", F.col("blocks")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
            .select("size", "b", "q", F.coalesce("id", F.lit(NO_ID)).alias("id"), "v"))
    asked = (dealt.where("asks and id is not null").withColumn("q", F.pmod("dealt", F.col("query_blocks")).cast("int"))
             .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.col("size").alias("to_size"), F.col("b").alias("to_b"), F.col("q").alias("own_q"), F.col("id").alias("query_id"), F.col("v").alias("point"), F.col("dealt").alias("row")))

    def meet(asking: pa.Table, found: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(asking) and len(found):
            ids, rows = (matrix(found, c) for c in ("id", "v"))
            block = Block(ids, rows, settings)
            wanted, points = (matrix(asking, c) for c in ("query_id", "point"))
            for query_id, point, row in zip(wanted.tolist(), points, asking.column("row").to_pylist(), strict=True):
                for distance, near in block.search(query_id, point, k):
                    for column, value in zip(out, (query_id, row, near, distance), strict=True):
                        column.append(value)
        return pa.table([pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "row", "near", "score"])

    grouped = asked.groupBy("to_size", "to_b", "own_q").cogroup(data.groupBy("size", "b", "q"))
    hits = grouped.applyInArrow(meet, "query_id long, row long, near long, score double")
    place = F.row_number().over(Window.partitionBy("query_id", "row").orderBy("score", "near"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.nullif("near", F.lit(NO_ID)).alias("vec_id"), "score")


def matrix(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks()
    if pa.types.is_list(values.type):
        return values.flatten().to_numpy().reshape(len(table), -1)
    return values.to_numpy()
