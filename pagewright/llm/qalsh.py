"""Approximate nearest neighbours by collision counting over single projections.

A shard of vectors keeps one sorted array for each of ``projections`` random
orthonormal directions.  A query is projected too; a vector collides with it in
a direction if it lies within the half-width w of the query's value: a window
centred on the query.  Vectors that collide in at least ``threshold`` of the
directions are verified by their exact measure.  Windows widen by virtual
rehashing (the arrays stay, only w grows) until a vector as near as the k-th
nearest verified one would have passed with probability ``confidence``; then
the shard's search ends.  There is no cap on candidates.

Largest inner product becomes nearest distance by one more component: vectors
are divided by the largest norm and completed to unit length, queries scaled to unit length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import with_integer_ids

PROJECTIONS, THRESHOLD, CONFIDENCE = 128, 0.7, 0.8
#: Vectors in a shard and queries in a block, about; what a task holds.
SHARD, BLOCK = 32_768, 512
SEED = 20
#: The first half-width, in units of the usual distance of a k-th neighbour, and its growth.
_START, _WIDEN = 1.0, 1.08
_PROBED = 16
#: Windows that hold more than this share of the sorted arrays are counted by rank, not by listing what they hold.
_BY_RANK = 0.1


def directions(dim: int, projections: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    """Columns of random orthonormal bases, as many as needed."""
    rng, found = np.random.default_rng(seed), []
    while sum(x.shape[1] for x in found) < projections:
        found.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
    return np.hstack(found)[:, :projections]


def _reach(projections: int, threshold: float, confidence: float) -> float:
    """w in units of a distance at which a vector that far passes with the confidence."""
    normal = NormalDist()
    z = normal.inv_cdf(confidence)
    low, high = 0.1, 8.0
    for _ in range(60):
        t = (low + high) / 2
        p = 2 * normal.cdf(t) - 1
        low, high = (t, high) if p - z * math.sqrt(p * (1 - p) / projections) < threshold else (low, t)
    return high


class Shard:
    """Vectors with their sorted projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, projections: int = PROJECTIONS, threshold: float = THRESHOLD, confidence: float = CONFIDENCE):
        self.ids, self.vectors, self.need = ids, vectors, math.ceil(threshold * projections)
        self.axes = directions(vectors.shape[1] + 1, projections)
        self.dim = vectors.shape[1] + 1
        unit = vectors / longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
        placed = np.hstack([unit, rest[:, None]]) @ self.axes * math.sqrt(self.dim)
        self.order = np.ascontiguousarray(np.argsort(placed, axis=0).T)
        self.sorted = np.take_along_axis(placed.T, self.order, axis=1)
        self.rank = np.empty(self.order.shape, dtype=np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.rank, self.order, np.arange(len(ids), dtype=self.rank.dtype)[None, :], axis=1)
        self.begin: dict[int, float] = {}
        self.verified = 0
        self.longest, self.reach = longest, _reach(projections, threshold, confidence)

    def _first_width(self, k: int) -> float:
        """From the exact k-th neighbours of a few members: where the first windows begin."""
        if k not in self.begin:
            some = self.vectors[:: max(1, len(self.vectors) // _PROBED)][:_PROBED] / self.longest
            inner = np.sort(some @ (self.vectors / self.longest).T, axis=1)[:, -min(k + 1, len(self.vectors))]
            square = (some * some).sum(axis=1)
            self.begin[k] = _START * float(np.median(np.sqrt(np.maximum(1e-6, 1 + square - 2 * inner))))
        return self.begin[k]

    def _window(self, place: np.ndarray, width: float) -> tuple[list[int], list[int]]:
        """First and last position within the width of the query, in each sorted array."""
        ends = [s.searchsorted((p - width, p + width)) for s, p in zip(self.sorted, place.tolist(), strict=True)]
        return [int(e[0]) for e in ends], [int(e[1]) for e in ends]

    def _count(self, parts: list[np.ndarray]) -> np.ndarray:
        return np.bincount(np.concatenate(parts), minlength=len(self.ids))

    def _collisions(self, low: list[int], high: list[int]) -> np.ndarray:
        """Collisions of every vector: how many of its ranks lie within the windows."""
        if sum(high) - sum(low) <= _BY_RANK * self.order.size:
            return self._count([o[a:b] for o, a, b in zip(self.order, low, high, strict=True)])
        counts, off, inside = np.zeros(len(self.ids), dtype=np.int32), np.empty_like(self.rank[0]), np.empty(len(self.ids), dtype=bool)
        for first in range(0, len(self.rank), 255):  # as many as a byte can count
            some = np.zeros(len(self.ids), dtype=np.uint8)
            for rank, a, b in zip(self.rank[first : first + 255], low[first:], high[first:], strict=False):
                np.less(np.subtract(rank, rank.dtype.type(a), out=off), rank.dtype.type(b - a), out=inside)  # ranks below a wrap round
                np.add(some, inside.view(np.uint8), out=some)
            counts += some
        return counts

    def _widened(self, counts: np.ndarray, low: list[int], high: list[int], new_low: list[int], new_high: list[int]) -> np.ndarray:
        """``counts`` with what wider windows add at both ends: virtual rehashing."""
        added = [o[a:b] for o, a, b in zip(self.order, new_low, low, strict=True)] + [o[a:b] for o, a, b in zip(self.order, high, new_high, strict=True)]
        return counts + self._count(added)

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, positions and measures of the best k found, best first, ties to the smaller id."""
        unit = np.hstack([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros((len(queries), 1))])
        places = unit @ self.axes * math.sqrt(self.dim)
        width = self._first_width(k)
        ends = np.array([s.searchsorted((p - width, p + width)) for s, p in zip(self.sorted, places.T, strict=True)])
        for query_id, vector, place, low, high in zip(ids, queries, places, ends[:, 0].T.tolist(), ends[:, 1].T.tolist(), strict=True):
            yield self._one(query_id, vector, place, k, width, low, high)

    def _one(self, query_id: int, vector: np.ndarray, place: np.ndarray, k: int, width: float, low: list[int], high: list[int]) -> tuple[np.ndarray, np.ndarray]:
        seen = self.ids == query_id
        k = min(k, len(self.ids) - int(seen.sum()))
        at, score = np.zeros(0, dtype=np.int64), np.zeros(0)
        if k == 0:
            return at, score
        norm = float(np.linalg.norm(vector))
        counts = self._collisions(low, high)
        while True:
            passed = np.flatnonzero((counts >= self.need) & ~seen)
            if len(passed):
                seen[passed] = True
                self.verified += len(passed)
                at = np.concatenate((at, passed))
                score = np.concatenate((score, np.einsum("ij,j->i", self.vectors[passed], vector)))
                if len(at) > k:
                    order = np.lexsort((self.ids[at], -score))[:k]
                    at, score = at[order], score[order]
            if seen.all():
                break
            if len(at) >= k:
                worst = math.sqrt(max(0.0, 2 - 2 * float(score.min()) / (self.longest * norm)))
                wanted = self.reach * worst
                if wanted <= width:
                    break
                width = min(wanted, width * _WIDEN)
            else:
                width *= _WIDEN
            wider = self._window(place, width)
            counts = self._widened(counts, low, high, *wider)
            low, high = wider
        order = np.lexsort((self.ids[at], -score))[:k]
        return at[order], score[order]


def usable_vector(vector_col: str = "embedding") -> Column:
    """Whether a vector is neither null nor zero and holds finite components only; never null."""
    v = F.col(vector_col)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, fine), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usual_length(rows: DataFrame, vector_col: str) -> tuple[int, int, float]:
    """The length that most vectors have (of equals the smaller), how many have it, and their largest square."""
    square = F.aggregate(vector_col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    found = rows.groupBy(F.size(vector_col).alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("most")).orderBy(F.desc("n"), "dim").first()
    return tuple(found) if found else (0, 0, 0.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each query, by inner product in double precision.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows without an id, nor vectors of another length than most of
    ``vectors`` have.  A query's own id is no candidate, in whatever row.  With
    fewer than k candidates all are returned; an empty table gives no rows.
    Rows that repeat an id are candidates each; of queries that repeat an id the
    one with the smallest vector is asked.  Ids that are no integers are an error.

    Every shard meets every block of queries, once; only the best k of each
    pair leave a task.  Blocks are dealt to groups, as many as keep the cluster busy; a
    shard's sorted arrays are built once a group, and its blocks stream past.
    """
    spark = vectors.sparkSession
    for df in (vectors, queries):
        with_integer_ids(df, id_col)
    kept = lambda df: df.where(usable_vector(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    dim, n, longest = usual_length(kept(vectors), "v")
    points, asked = kept(vectors).where(F.size("v") == dim), kept(queries).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    m = asked.count()
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = math.sqrt(longest)
    shards, blocks = -(-n // shard), -(-m // block)
    groups = max(1, min(blocks, -(-2 * spark.sparkContext.defaultParallelism // shards)))

    def packed(rows: DataFrame, parts: int, name: str, salt: Column) -> DataFrame:
        dealt = rows.withColumn(name, F.pmod(F.xxhash64("id", salt), F.lit(parts)).cast("int"))
        return dealt.groupBy(name).agg(F.collect_list(F.struct("id", "v")).alias("rows"))

    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    index = packed(points, shards, "s", F.xxhash64("v")).select("s", every(groups).alias("g"), F.lit(False).alias("asked"), "rows")
    blocks_of = packed(asked, blocks, "b", F.lit(7)).select(F.col("b"), every(shards).alias("s"), "rows").select("s", F.pmod("b", F.lit(groups)).cast("int").alias("g"), F.lit(True).alias("asked"), "rows")
    met = index.unionByName(blocks_of).repartitionById(shards * groups, F.col("s") * groups + F.col("g")).sortWithinPartitions("s", "g", "asked")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, None
        for batch in batches:
            for s, g, is_asked, rows in zip(*(c for c in batch.columns), strict=True):
                ids, v = rows.values.field("id").to_numpy(), _matrix(rows.values.field("v"))
                if not is_asked.as_py():
                    here, at = Shard(ids, v, longest), (s.as_py(), g.as_py())
                elif (s.as_py(), g.as_py()) == at:  # else the shard holds nothing
                    found = list(here.search(ids, v, k))
                    sizes = [len(x[0]) for x in found]
                    values = [np.repeat(ids, sizes), here.ids[np.concatenate([x[0] for x in found])], np.concatenate([x[1] for x in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=["query_id", "vec_id", "score"])

    hits = met.mapInArrow(work, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
