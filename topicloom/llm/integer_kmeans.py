"""Centroid clustering in exact integers with an equal-average equal-variance search (operator 12).

Vectors become integers, floor(scale * x), once, in a stored table.  Lloyd's rounds are jobs over that table: the centroids, a table of checked size, travel
with the tasks; a task keeps the sums and counts of its own vectors by centroid, these few rows are added up in Spark, and the next centroids
are the exact floors of sum / count.  No vector is exchanged.

The nearest centroid is found without comparing all.  Centroids are sorted by their component sum S (their mean, times the dimensions D).  From
the place of the vector's own sum the search goes outward on both sides, nearer sum first.  Two bounds reject a centroid before any of its components is read:

    D * d2 >= (S_x - S_c) ** 2                                the mean; exact; a side on which it exceeds the best distance is finished
    d2     >= (S_x - S_c) ** 2 / D + (sd_x - sd_c) ** 2        with the deviations sd = sqrt(sum x ** 2 - S ** 2 / D)

The second is computed in doubles and lowered by more than their error, so that it never rejects a nearer or equal centroid.  What is left is measured in 64-bit
integers; of equal distances the smaller number wins.

Defined cases: vectors that are null, of another length, or hold null or non-finite components have no row; components of ``Plan.limit`` (2 ** 24) or more after scaling raise
``ArithmeticError``, since their distances would leave 64 bits; with fewer kept vectors than centroids there are as many centroids as vectors; repeated
rows and ids each count and each get a row; a null id is hashed as the empty text; the first centroids are ordered by hash, then by components; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import materialise

MAX_CENTROID_CELLS = 8_000_000  # 64 MB of centroids, the most that is sent to a task


@dataclass(frozen=True)
class Plan:
    clusters: int = 8
    rounds: int = 10
    dimensions: int = 64
    scale: int = 1024
    seed: int = 3

    @property
    def limit(self) -> int:
        """Below it no distance, and no difference of sums squared, leaves 64 bits: 2 ** 24 for 64 dimensions."""
        return isqrt((1 << 62) // (4 * self.dimensions ** 2))


def integer_vectors(vectors: DataFrame, plan: Plan, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the usable vectors as integers."""
    dimensions, scale, limit = plan.dimensions, plan.scale, plan.limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(1)  # all of the right length
            flat = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimensions)  # a null becomes not-a-number
            good = np.isfinite(flat).all(axis=1)
            whole = np.floor(flat[good] * scale)
            if whole.size and np.abs(whole).max() >= limit:
                raise ArithmeticError(f"a component of {limit} or more after scaling")
            offsets = np.arange(0, whole.size + 1, dimensions, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(offsets, pa.array(whole.astype(np.int32).ravel()))], names=["vec_id", "v"])

    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return slim.where(F.size("v") == dimensions).mapInArrow(run, "vec_id long, v array<int>")


def first_centroids(stored: DataFrame, plan: Plan) -> np.ndarray:
    """The vectors of the smallest hashes, (clusters, dimensions)."""
    mark = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = stored.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(plan.clusters).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, plan.dimensions)


class MeanOrder:
    """Centroids in the order of their sums, and the search for the nearest."""

    def __init__(self, centroids: np.ndarray) -> None:
        sums = centroids.sum(axis=1)
        self.number = np.argsort(sums, kind="stable")
        self.centroids, self.sums = centroids[self.number], sums[self.number]
        self.energy = self._energy(self.centroids, self.sums)
        self.deviation = np.sqrt(self.energy)

    @staticmethod
    def _energy(v: np.ndarray, sums: np.ndarray) -> np.ndarray:
        d = v.shape[1]
        return (d * (v * v).sum(axis=1) - sums * sums) / d

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each vector's nearest centroid, and how many distances were measured."""
        n, d = v.shape
        sums = v.sum(axis=1)
        energy = self._energy(v, sums)
        deviation = np.sqrt(energy)
        k = len(self.sums)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        best = np.full(n, -1, np.int64)
        least = np.full(n, np.iinfo(np.int64).max // d, np.int64)
        measured = 0
        going = np.arange(n)
        while len(going):
            low, high = left[going], right[going]
            below = np.where(low >= 0, sums[going] - self.sums[np.maximum(low, 0)], -1)
            above = np.where(high < k, self.sums[np.minimum(high, k - 1)] - sums[going], -1)
            down = (below >= 0) & ((above < 0) | (below <= above))
            gap = np.where(down, below, above)
            # the nearer sum is beyond the best distance, or both sides are at their end: nothing is left
            alive = (gap >= 0) & (gap * gap <= d * least[going])
            going, down, gap = going[alive], down[alive], gap[alive]
            if not len(going):
                break
            at = np.where(down, left[going], right[going])
            left[going] -= down
            right[going] += ~down
            apart = deviation[going] - self.deviation[at]
            bound = gap.astype(np.float64) ** 2 / d + apart * apart - 1e-9 * (energy[going] + self.energy[at]) - 1
            near = bound <= least[going]
            rows, at = going[near], at[near]
            measured += len(rows)
            apart = v[rows] - self.centroids[at]
            distance = (apart * apart).sum(axis=1)
            number = self.number[at]
            better = (distance < least[rows]) | ((distance == least[rows]) & (number < best[rows])) | (best[rows] < 0)
            least[rows[better]], best[rows[better]] = distance[better], number[better]
        return best, least, measured


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def next_centroids(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floors of the means of what each centroid is nearest to; an empty one stays."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = MeanOrder(centroids)
        sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(0), d)
                best, _, _ = order.nearest(v)
                np.add.at(sums, best, v)
                counts += np.bincount(best, minlength=k)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.ListArray.from_arrays(np.arange(0, len(used) * d + 1, d, dtype=np.int32), pa.array(sums[used].ravel()))],
            names=["cluster", "n", "sums"])

    parts = stored.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(
        F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    result = centroids.copy()
    for row in cells.collect():  # clusters x dimensions rows, checked by the caller
        result[row["cluster"], row["i"]] = int(row["x"]) // row["n"]
    return result


def centroid_hash(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


RESULT = "vec_id long, cluster int, distance long"


def cluster_vectors(vectors: DataFrame, plan: Plan = Plan(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    if plan.clusters * plan.dimensions > MAX_CENTROID_CELLS:
        raise ValueError(f"more than {MAX_CENTROID_CELLS} centroid components")
    spark = vectors.sparkSession
    stored = materialise(integer_vectors(vectors, plan, id_col, vector_col), "integers")
    centroids = first_centroids(stored, plan)
    for _ in range(plan.rounds if len(centroids) else 0):
        following = next_centroids(stored, centroids)
        if (following == centroids).all():  # nothing moves any more, so the rounds left would not change it either
            break
        centroids = following

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = MeanOrder(centroids)
        for batch in batches:
            if batch.num_rows:
                best, least, _ = order.nearest(_matrix(batch.column(1), plan.dimensions))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(least)], names=["vec_id", "cluster", "distance"])

    assigned = materialise(stored.mapInArrow(run, RESULT), "assigned")
    per_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia"))
    total = per_cluster.agg(F.sum("cluster_inertia")).first()[0]
    hashes = spark.createDataFrame([(i, centroid_hash(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    return assigned.join(F.broadcast(per_cluster.join(hashes, "cluster")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
