"""Centroid clustering of integer vectors with Orchard's search for the nearest centroid.

Every centroid has a list of the others, nearest first, with their squared distances. The search for a vector begins at
one centroid and walks that one's list. A centroid on it that is closer to the vector (or as close, with a smaller number)
becomes the current one and its own list is walked from the start; centroids once measured are marked and not measured again.
The walk ends strictly beyond twice the current distance: a centroid c' with D(c, c') > 4 D(x, c), squared, is farther from x
than c, while one at exactly twice the distance may tie and is still measured. All distances are exact integers.

A round is one pass over the vectors: each task assigns its own batches (all vectors of a batch walk side by side) and sums
up components and counts per centroid, so a task sends k x components rows however many vectors it holds or however they
crowd around one centroid. Sums travel as 32-bit limbs and are exact at any size. Only centroids and k sums reach the driver.

Edge cases: a vector counts only with the right number of components, none NULL, NaN or infinite; the others give no row.
Fewer kept vectors than k give as many centroids, none give an empty result. Repeated rows are rows like others; among equal
hashes (repeated or NULL ids, a NULL id hashes as the empty id) the smaller vector comes first. Components too large for
64-bit distances are computed with unbounded integers; a distance beyond 64 bits is NULL, and so are the sums over it.
"""

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LIMB = 32


def integer_vectors(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the usable vectors, and which rows they are. Every row has ``dims`` components."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    usable = np.isfinite(values).all(axis=1)
    values = values[usable]
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not values.size or np.abs(scaled).max() <= narrow_limit(dims):
        return scaled.astype(np.int64), usable
    exact = [[_floor_times(float(x), scale) for x in row] for row in values]
    return np.array(exact, dtype=object), usable


def _floor_times(x: float, scale: int) -> int:
    top, bottom = x.as_integer_ratio()
    return top * scale // bottom


def narrow_limit(dims: int) -> int:
    """The largest component with which four times a squared distance stays within 62 bits."""
    return isqrt(2**58 // dims)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=1) if d.dtype == object else np.einsum("ij,ij->i", d, d)


class Neighbours:
    """The centroids and, per centroid, the others by distance."""

    def __init__(self, centroids: list[list[int]]):
        dims = len(centroids[0])
        wide = max(abs(v) for c in centroids for v in c) > narrow_limit(dims)
        self.centroids = np.array(centroids, dtype=object if wide else np.int64)
        self.k = len(centroids)
        lists, gaps = [], []
        for i in range(self.k):
            others = np.array([j for j in range(self.k) if j != i], dtype=np.int64)
            away = squared(self.centroids[others], self.centroids[i][None, :])
            order = np.argsort(away, kind="stable")
            lists.append(others[order])
            gaps.append(away[order])
        self.lists, self.gaps = np.array(lists), np.array(gaps)

    def nearest(self, points: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Centroid and squared distance of every point, and how many distances were measured."""
        if points.dtype == object or self.centroids.dtype == object:
            points, centroids = points.astype(object), self.centroids.astype(object)
        else:
            centroids = self.centroids
        m = len(points)
        at, step = np.full(m, start, np.int64), np.zeros(m, np.int64)
        best = squared(points, centroids[at])
        seen = np.zeros((m, self.k), bool)
        seen[:, start] = True
        measured, walking = m, np.arange(m)
        while True:
            walking = walking[step[walking] < self.k - 1]
            if not walking.size:
                return at, best, measured
            here, place = at[walking], step[walking]
            within = (self.gaps[here, place] <= 4 * best[walking]).astype(bool)
            walking, here, place = walking[within], here[within], place[within]
            other = self.lists[here, place]
            step[walking] += 1
            fresh = ~seen[walking, other]
            rows, other, here = walking[fresh], other[fresh], here[fresh]
            seen[rows, other] = True
            measured += rows.size
            away = squared(points[rows], centroids[other])
            closer = ((away < best[rows]) | ((away == best[rows]) & (other < here))).astype(bool)
            moved = rows[closer]
            at[moved], best[moved], step[moved] = other[closer], away[closer], 0


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """The value as low 32-bit digits and one signed rest."""
    place = 0
    while not -(1 << 31) <= value < (1 << 31):
        yield place, value & ((1 << LIMB) - 1)
        value, place = value >> LIMB, place + 1
    yield place, value


def _vectors(table: DataFrame, dims: int) -> DataFrame:
    return table.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(F.size("embedding") == dims)


def first_centroids(table: DataFrame, k: int, dims: int, scale: int, seed: int) -> list[list[int]]:
    """The k usable vectors whose ids have the smallest hashes; every task keeps its own k only."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    plain = F.transform("embedding", lambda x: x.cast("double"))
    wrong = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (_vectors(table, dims).select(order.alias("h"), plain.alias("v")).filter(~wrong)
            .orderBy("h", "v").limit(k).collect())
    return [[_floor_times(x, scale) for x in r["v"]] for r in rows]


def _sums(table: DataFrame, lists: Neighbours, dims: int, scale: int) -> dict[tuple[int, int], int]:
    """Per (centroid, component) the exact sum over its vectors; component -1 is their number."""
    schema = pa.schema([("centroid", pa.int32()), ("component", pa.int32()), ("limb", pa.int32()), ("part", pa.int64())])

    def summed(batches):
        total, count = np.zeros((lists.k, dims), dtype=object), np.zeros(lists.k, np.int64)
        for batch in batches:
            points, _ = integer_vectors(batch.column("embedding"), dims, scale)
            nearest = lists.nearest(points)[0]
            for c in np.unique(nearest):
                own = points[nearest == c]
                count[c] += len(own)
                total[c] += own.sum(axis=0).astype(object)
        rows = [(c, -1, 0, int(count[c])) for c in range(lists.k) if count[c]]
        rows += [(c, d, *limb) for c in range(lists.k) if count[c] for d in range(dims) for limb in _limbs(int(total[c, d]))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema) if rows else \
            pa.RecordBatch.from_pylist([], schema)

    parts = _vectors(table, dims).select("embedding").mapInArrow(summed, "centroid int, component int, limb int, part bigint")
    sums: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("centroid", "component", "limb").agg(F.sum("part").alias("part")).collect():
        key = (r["centroid"], r["component"])
        sums[key] = sums.get(key, 0) + (r["part"] << (LIMB * r["limb"]))
    return sums


def cluster(table: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1):
    """The centroids after ``rounds`` rounds; an empty one stays where it was."""
    centroids = first_centroids(table, k, dims, scale, seed)
    for _ in range(rounds if centroids else 0):
        sums = _sums(table, Neighbours(centroids), dims, scale)
        centroids = [[sums[c, d] // sums[c, -1] for d in range(dims)] if (c, -1) in sums else old for c, old in enumerate(centroids)]
    return centroids


def assign(table: DataFrame, centroids: list[list[int]], dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster and squared distance of every usable vector."""
    lists = Neighbours(centroids)

    def found(batches):
        for batch in batches:
            points, usable = integer_vectors(batch.column("embedding"), dims, scale)
            nearest, away, _ = lists.nearest(points)
            distances = [d if d < 2**63 else None for d in away.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").filter(pa.array(usable)), pa.array(nearest, pa.int32()), pa.array(distances, pa.int64())],
                names=["vec_id", "cluster", "distance"])

    return _vectors(table, dims).mapInArrow(found, "vec_id bigint, cluster int, distance bigint")


def clusters(table: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """Every usable vector with its cluster, its distance, the sums of distances and a digest of the centroid."""
    spark = table.sparkSession
    centroids = cluster(table, k, rounds, dims, scale, seed)
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not centroids:
        nothing = spark.createDataFrame([], "vec_id bigint, distance bigint, " + schema)
        return nothing.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assigned = written(assign(table, centroids, dims, scale), "assigned")
    sums = {r["cluster"]: r for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(19,0)")).alias("total"), F.count("distance").alias("known"), F.count("*").alias("n")).collect()}

    def fitting(of):
        total = sum(int(r["total"] or 0) for r in of)
        return total if total < 2**63 and all(r["known"] == r["n"] for r in of) else None

    everything = fitting(sums.values())
    # k rows, so their size is known.
    facts = spark.createDataFrame(
        [(c, fitting([r]), everything, sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, r in sums.items()], schema)
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
