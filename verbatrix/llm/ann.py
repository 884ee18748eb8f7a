"""Nearest neighbours by query-aware collision counting.

Every vector is projected on m random directions, and each projection of a
block of vectors is kept as a sorted array. A query's windows are centred on
its own projections. Virtual rehashing widens all of them by the same factor
from level to level; a vector collides with the query in a projection if it
lies in the window there. Vectors whose collisions reach the threshold are
verified by their distance. The search of a query ends at the level whose
radius holds its k verified neighbours, or when all vectors are verified.

The threshold follows from the directions and the window alone: a vector at
the level's radius collides in each projection with a known probability, and
reaches the threshold with probability ``PASS`` or more, whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.llm import common

K = 10
PROJECTIONS = 64
#: Half a window's width as a multiple of the level's radius.
HALF = 0.9
#: Chance that a vector at the level's radius reaches the threshold.
PASS = 0.93
FACTOR = 1.25
#: Vectors in a block of the base, and of queries.
BASE, QUERIES = 32768, 16384
#: The registered search asks for the neighbours of the vectors whose id this divides.
ASKED_EVERY = 20
RESULT = "vec_id bigint, neighbor_id bigint, rank int, distance double"


def threshold(m: int = PROJECTIONS, half: float = HALF, least: float = PASS) -> int:
    """Collisions that a vector at the radius has at least, with the given chance."""
    p = 2 * NormalDist().cdf(half) - 1
    tail, chance = 0.0, math.comb(m, 0) * (1 - p) ** m
    for c in range(m + 1):
        if tail + chance > 1 - least:
            return c
        tail += chance
        chance *= (m - c) / (c + 1) * p / (1 - p)
    return m


class Block:
    """Sorted projections of up to 65,536 vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: np.ndarray):
        self.ids, self.vectors = ids, vectors
        projected = vectors @ directions
        order = np.argsort(projected, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T.astype(np.int32))
        self.sorted = np.ascontiguousarray(np.take_along_axis(projected, order, 0).T)
        self.rank = np.empty_like(self.order, dtype=np.uint16)
        np.put_along_axis(self.rank, self.order, np.arange(len(ids), dtype=np.uint16)[None, :], 1)
        # all sorted arrays as one, each moved past the end of the one before
        low, high = self.sorted.min(initial=0.0), self.sorted.max(initial=0.0)
        self.step = 4.0 * (float(high) - float(low)) + 1.0
        self.moved = np.arange(len(self.sorted)) * self.step
        self.joined = (self.sorted.astype(np.float64) + self.moved[:, None]).ravel()
        self.low, self.high = float(low), float(high)

    def collisions(self, centre: np.ndarray, width: float) -> np.ndarray:
        """Projections in which each vector lies within ``width`` of the centre."""
        n, m = len(self.ids), len(self.sorted)
        count, hit, inside = np.zeros(n, np.uint8), np.empty(n, np.uint16), np.empty(n, bool)
        # windows end where the projections do, so that they stay in their own array
        ends = np.clip(np.concatenate([centre - width, centre + width]), self.low - 0.5, self.high + 0.5) + np.concatenate([self.moved, self.moved])
        found = np.searchsorted(self.joined, ends)
        lo, hi = (found[:m] - np.arange(m) * n).tolist(), (found[m:] - np.arange(m) * n).tolist()
        for j in range(m):
            width_j = hi[j] - lo[j]
            if width_j > n >> 4:
                # a wide window: positions in the sorted array are compared with its ends
                np.subtract(self.rank[j], np.uint16(lo[j]), out=hit)
                np.less_equal(hit, np.uint16(width_j - 1), out=inside)
                np.add(count, inside.view(np.uint8), out=count)
            elif width_j > 0:
                count[self.order[j, lo[j] : hi[j]]] += 1
        return count

    def at_level(self, q: np.ndarray, centre: np.ndarray, others: np.ndarray, left: int, k: int, radius: float, need: int, half: float) -> tuple[bool, np.ndarray, np.ndarray]:
        """Whether the search of a query ends at ``radius``, and its k best verified
        vectors there with their distances; ties go to the smaller id."""
        found = np.flatnonzero((self.collisions(centre, half * radius) >= need) & others)
        if len(found) < min(k, left):
            return False, found, np.zeros(0)
        far = np.sqrt(((self.vectors[found] - q) ** 2).sum(1, dtype=np.float64))
        if len(found) > 4 * k:
            near = far <= np.partition(far, k - 1)[k - 1]
            found, far = found[near], far[near]
        best = np.lexsort((self.ids[found], far))[:k]
        found, far = found[best], far[best]
        return (len(found) >= k and far[-1] <= radius), found, far

    def search(self, own: int, q: np.ndarray, centre: np.ndarray, k: int, radius: float, need: int, half: float, factor: float, guess: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(row numbers, distances) of the k nearest verified vectors that aren't the
        query's own id, and the first level at which the search ends. Windows are
        nested, so that it ends at every later level too: it is looked for from ``guess``."""
        others = self.ids != own
        left = int(np.count_nonzero(others))
        if not left:
            return np.zeros(0, np.int64), np.zeros(0), guess
        reach = max(self.high - float(centre.min()), float(centre.max()) - self.low, 1e-12)
        # at the top level every window covers its whole array
        top = max(0, math.ceil(math.log(max(reach * 1.001 / (half * radius), 1e-300)) / math.log(factor)))
        level = min(guess, top)
        done, found, far = self.at_level(q, centre, others, left, k, radius * factor**level, need, half)
        if done or level == top:
            while level > 0:
                lower = self.at_level(q, centre, others, left, k, radius * factor ** (level - 1), need, half)
                if not lower[0]:
                    break
                level, (_, found, far) = level - 1, lower
            return found, far, level
        while not done and level < top:
            level += 1
            done, found, far = self.at_level(q, centre, others, left, k, radius * factor**level, need, half)
        return found, far, level


def _rows(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    flat = table["v"].combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return table["id"].to_numpy(), flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _search(dim: int, k: int, m: int, need: int, half: float, factor: float, radius: float):
    directions = np.random.default_rng(20240611).standard_normal((dim, m)).astype(np.float32)

    def run(queries: pa.Table, base: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and base.num_rows:
            ids, vectors = _rows(base, dim)
            block = Block(ids, vectors, directions)
            qid, q = _rows(queries, dim)
            centre = q @ directions
            level = 0
            for i in range(len(qid)):
                found, far, level = block.search(qid[i], q[i], centre[i], k, radius, need, half, factor, level)
                out.append((np.full(len(found), qid[i]), ids[found], far))
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(parts[0].astype(np.int64)), pa.array(parts[1].astype(np.int64)), pa.array(parts[2].astype(np.float64))], ["vec_id", "neighbor_id", "distance"])

    return run


def nearest(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = PROJECTIONS, half: float = HALF, least: float = PASS, factor: float = FACTOR, base: int = BASE, queries: int = QUERIES, every: int = 1) -> DataFrame:
    """``vec_id, neighbor_id, rank, distance`` (Euclidean): for every vector whose id
    ``every`` divides its k nearest others of all vectors, approximately; ranks count from 1, ties go to the smaller id.

    Vectors that are null, contain a null, NaN or infinite value, or whose length is
    not the most frequent one (the smaller of equally frequent ones) take no part, nor do rows with null id.
    Ids that repeat with one vector are one; with several, the first by value counts. A vector that no other is
    there for has no rows. No rows: no rows. Further columns aren't read.
    """
    spark = vectors.sparkSession
    clean = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    clean = clean.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size("v") > 0))
    lengths = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], RESULT)
    dim = lengths["d"]
    clean = common.cut(clean.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")))
    asking = F.col("id") % every == 0
    n, q = clean.agg(F.count("*"), F.count(F.when(asking, 1))).first()
    bases = max(1, -(-n // min(base, 60000)))
    # each pair of blocks is one task's work: blocks of queries are smaller where tasks would be few
    parts = max(1, -(-q // queries), min(-(-common.partitions(spark) // bases), -(-q // 256)))
    # the first radius: a fortieth of the usual distance from the origin
    norm = clean.agg(F.avg(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()[0] or 0.0
    radius = max(norm / 40, 1e-6)
    number = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(of))
    asked = clean.where(asking).select("id", "v", number(5, parts).alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bases - 1).cast("bigint"))).alias("block"))
    held = clean.select("id", "v", number(7, bases).alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"))
    need = threshold(projections, half, least)
    pairs = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(_search(dim, k, projections, need, half, factor, radius), "vec_id bigint, neighbor_id bigint, distance double")
    # the k best over all blocks of the base
    best = pairs.groupBy("vec_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbor_id"))), 1, k).alias("best"))
    return best.select("vec_id", F.posexplode("best").alias("at", "n")).select("vec_id", F.col("n.neighbor_id").alias("neighbor_id"), (F.col("at") + 1).alias("rank"), F.col("n.distance").alias("distance"))


def op2_ann(spark, sf_dir: str) -> DataFrame:
    """Neighbours of every vector whose id 20 divides, among all vectors."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=ASKED_EVERY)
