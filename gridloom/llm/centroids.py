"""Clustering around centroids with a tournament of bisectors.

For a pair of centroids a < b the plane halfway between them has the normal 2(b - a) and the
threshold b.b - a.a: a vector x is nearer to b exactly when normal.x > threshold, and at zero
both are equally near, which favours the smaller number. The normals and thresholds of all pairs
are computed once for each set of centroids; a vector then meets the centroids in turn, k - 1 sign
tests in all, each of which eliminates one of two. Only the distance to the winner is computed.

Everything is in whole numbers. Components below 2^26 are worked on as 64-bit integers, whose
sums of products cannot overflow up to 256 components; larger ones as Python's integers, by the
same code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.session import checkpointed

_BLOCK = 4096  # vectors worked on at once
_SMALL = 1 << 26  # components below it need no more than 64 bits
_LIMB = 32  # sums travel in limbs of so many bits


class Bisectors:
    """Normals and thresholds of all pairs of centroids; k * k * d numbers."""

    def __init__(self, centroids: list[list[int]]):
        points = np.array(centroids, dtype=object)
        self.small = all(-_SMALL < x < _SMALL for c in centroids for x in c) and points.shape[1] <= 256
        points = points.astype(np.int64) if self.small else points
        # normals[a, b] separates a from b; only a < b is ever asked for.
        self.points = points
        self.normals = 2 * (points[None, :, :] - points[:, None, :])
        square = (points * points).sum(axis=1)
        self.thresholds = square[None, :] - square[:, None]

    def winners(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row and the squared distance to it."""
        winner = np.zeros(len(vectors), np.int64)
        for rival in range(1, len(self.points)):
            side = (self.normals[winner, rival] * vectors).sum(axis=1)
            winner[side > self.thresholds[winner, rival]] = rival
        gap = vectors - self.points[winner]
        return winner, (gap * gap).sum(axis=1)


def scaled(vectors: pa.Array, size: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, one row per vector of ``size`` components."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), size)
    with np.errstate(over="ignore"):
        whole = np.floor(scale * rows)
    if whole.size and not np.abs(whole).max() < _SMALL:
        # A product past the range of a double is computed exactly as well.
        exact = [int(x) * scale if abs(x) >= 2.0**53 else int(y) for x, y in zip(flat, whole.ravel())]
        return np.array(exact, dtype=object).reshape(rows.shape)
    return whole.astype(np.int64)


def _blocks(batches, bisectors: Bisectors, size: int, scale: int):
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(at, _BLOCK)
            vectors = scaled(part.column("vector"), size, scale)
            if not bisectors.small:
                vectors = vectors.astype(object)
            yield part, vectors, *bisectors.winners(vectors)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """``value`` as limbs (number, limb) whose sums stay far below 64 bits."""
    at = 0
    while not -(1 << _LIMB) < value < 1 << _LIMB:
        yield at, value & ((1 << _LIMB) - 1)
        value >>= _LIMB
        at += 1
    yield at, value


def component_sums(rows: DataFrame, centroids: list[list[int]], scale: int) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and sums of components for every cluster that has any.

    Each task adds up its own vectors; what meets on the driver is a row for each cluster,
    component and limb.
    """
    bisectors, size = Bisectors(centroids), len(centroids[0])

    def add(batches):
        totals: dict[int, list[int]] = {}
        for _, vectors, winner, _ in _blocks(batches, bisectors, size, scale):
            for c in np.unique(winner).tolist():
                mine = vectors[winner == c]
                new = [len(mine), *mine.sum(axis=0).tolist()]
                totals[c] = [a + b for a, b in zip(totals[c], new)] if c in totals else new
        found = [(c, i, n, x) for c, t in totals.items() for i, v in enumerate(t) for n, x in _limbs(v)]
        columns = list(zip(*found)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "at", "limb", "value"])

    sums = rows.select("vector").mapInArrow(add, "cluster long, at long, limb long, value long")
    out: dict[int, list[int]] = {}
    for r in sums.groupBy("cluster", "at", "limb").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r.cluster, [0] * (size + 1))[r["at"]] += r.value << (_LIMB * r.limb)
    return {c: (t[0], t[1:]) for c, t in out.items()}


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """``id`` and ``vector`` of the rows with ``size`` components, none NULL or non-finite."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = "size(vector) = {0} and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return rows.where("vector is not null").where(fine.format(size))


def first_centroids(rows: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest hash of seed and id; equal ids go by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    picked = rows.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    if not picked:
        return []
    size = len(picked[0].vector)
    return scaled(pa.array([r.vector for r in picked], pa.list_(pa.float64())), size, scale).tolist()


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 16,
    size: int = 64,
    scale: int = 64,
    rounds: int = 3,
    seed: int = 1,
) -> DataFrame:
    """Assign every usable vector to the nearest of k centroids moved ``rounds`` times.

    Columns: ``id_col``, cluster, distance (squared), cluster_inertia and inertia (its sums over
    the cluster and over all), centroid_sha256. Rows whose vector is NULL, has another number of
    components than ``size``, or holds NULL or non-finite ones are left out. A NULL id counts as
    an id without digits; rows that repeat an id, or a vector, all take part. With fewer than k
    vectors there are as many centroids as vectors, and an empty table gives an empty result. A
    distance or sum that a long cannot hold is NULL. Other columns are not looked at.

    The vectors are read once for the centroids they start from, once a round and once for the
    result. The driver holds the centroids only: k * size sums come to it each round.
    """
    spark, rows = vectors.sparkSession, usable_vectors(vectors, id_col, vector_col, size)
    id_type = rows.schema["id"].dataType
    centroids = first_centroids(rows, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        for c, (count, total) in component_sums(rows, centroids, scale).items():
            centroids[c] = [x // count for x in total]
    bisectors = Bisectors(centroids) if centroids else None

    def assign(batches):
        for part, _, winner, distance in _blocks(batches, bisectors, size, scale) if bisectors else ():
            kept = [x if x < 1 << 63 else None for x in distance.tolist()]
            columns = [part.column("id"), pa.array(winner, pa.int32()), pa.array(kept, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    schema = f"id {id_type.simpleString()}, cluster int, distance long"
    assigned = checkpointed(rows.mapInArrow(assign, schema))
    # A row for each centroid, so the broadcast is bounded by k.
    whole = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = assigned.groupBy("cluster").agg(whole.alias("total")).collect()
    parts = {r.cluster: r.total for r in sums}
    every = None if None in parts.values() else sum(parts.values())
    named = [
        (
            c,
            *(int(x) if x is not None and x < 1 << 63 else None for x in (parts.get(c, 0), every)),
            hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest(),
        )
        for c, centroid in enumerate(centroids)
    ]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = assigned.join(F.broadcast(about), "cluster")
    return joined.select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
