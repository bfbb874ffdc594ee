"""Centroid clustering of whole-number vectors, exact at every step.

Squared distances come from ``|x|^2 - 2 x.c + |c|^2`` with one matrix product
a block. All of it is whole numbers, so float64 BLAS is exact while no value
can reach 2**53; a block for which it could goes through integers instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import saved
from .vectors import EXACT, LONG, big, floors, matrices, sound

CLUSTERS, ROUNDS, SCALE, DIMENSION, SEED = 16, 3, 64, 64, "1"
#: Components of a block of vectors, and of all centroids, at most.
BLOCK, MOST = 1 << 19, 1 << 22


class Centroids:
    """Centroids as Python integers, and as floats where those are exact."""

    def __init__(self, rows: list[list[int]]):
        self.rows = np.array(rows, dtype=object).reshape(len(rows), len(rows[0]) if rows else 0)
        self.reach = max((abs(v) for row in rows for v in row), default=0)
        self.floats = self.rows.astype(float) if self.reach < EXACT else None
        self.longs = self.rows.astype(np.int64) if self.reach < LONG else None

    def nearest(self, x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whole-number rows, number of the nearest centroid, squared distance); ties go to the smaller number."""
        whole = floors(x, scale)
        reach = float(np.abs(whole).max(initial=0))
        bound = x.shape[1] * (int(reach) + self.reach) ** 2 if np.isfinite(reach) else LONG
        if bound < EXACT:
            c = self.floats
            d = (whole * whole).sum(axis=1)[:, None] - 2 * (whole @ c.T) + (c * c).sum(axis=1)
            rows = whole.astype(np.int64)
        else:
            rows, c = (whole.astype(np.int64), self.longs) if bound < LONG else (big(x, scale), self.rows)
            d = np.stack([((rows - one) ** 2).sum(axis=1) for one in c], axis=1)
        cluster = np.argmin(d, axis=1) if d.dtype != object else np.array([min(range(len(c)), key=row.__getitem__) for row in d], np.int64)
        return rows, cluster, d[np.arange(len(d)), cluster]


def part_sums(centroids: Centroids, scale: int, batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[int, np.ndarray]]:
    """{cluster: (vectors, componentwise sum as Python integers)} of one part."""
    d, total = centroids.rows.shape[1], {}
    for batch in batches:
        for x in blocks(batch.column(0), d)[1]:
            rows, cluster, _ = centroids.nearest(x, scale)
            safe = rows.dtype != object and len(rows) * int(np.abs(rows).max(initial=0)) < LONG
            for k in np.unique(cluster).tolist():
                own = rows[cluster == k]
                own = (own.sum(axis=0) if safe else own.astype(object).sum(axis=0)).astype(object)
                n, before = total.get(k, (0, 0))
                total[k] = n + int((cluster == k).sum()), before + own
    return total


def blocks(lists: pa.Array, d: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places of the sound vectors, their rows in blocks)."""
    at, x = matrices(lists, d)
    step = max(1, BLOCK // max(1, d))
    return at, [x[k : k + step] for k in range(0, len(x), step)]


def added(a: dict, b: dict) -> dict:
    for k, (n, total) in b.items():
        m, before = a.get(k, (0, 0))
        a[k] = m + n, before + total
    return a


def next_centroids(vectors: DataFrame, centroids: Centroids, scale: int) -> Centroids:
    """Each centroid moved to the floor of its vectors' mean; one without vectors stays.

    A task gives one row of sums, which an RDD tree aggregation combines: no
    more than clusters x dimension whole numbers from any task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (n, total) in part_sums(centroids, scale, batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([[str(v) for v in total]], pa.list_(pa.string()))], ["k", "n", "total"])

    parts = vectors.mapInArrow(run, "k int, n long, total array<string>").rdd
    sums = parts.treeAggregate({}, lambda a, r: added(a, {r["k"]: (r["n"], np.array([int(v) for v in r["total"]], dtype=object))}), added)
    rows = centroids.rows.copy()
    for k, (n, total) in sums.items():
        rows[k] = [v // n for v in total]
    return Centroids(rows.tolist())


def first_centroids(kept: DataFrame, clusters: int, scale: int, seed: str) -> Centroids:
    """The vectors of smallest sha256 of ``seed:id``, in that order; repeated ids by components, null ids not at all."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.col("id").cast("string")), 256)
    picked = kept.where("id IS NOT NULL").select(digest.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return Centroids([big(np.array([r["v"]], float), scale)[0].tolist() for r in picked])


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dimension: int = DIMENSION, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept.

    Kept are the vectors of ``dimension`` components, none null or non-finite,
    with components ``floor(scale * x)``. Null ids are clustered but start no
    centroid; repeated rows are vectors each; of fewer vectors than
    ``clusters`` all start one; other columns, whatever their names, are
    ignored; an empty table gives no rows. A distance or a sum of them beyond a
    long is null, the cluster is right all the same.

    Vectors are read where they lie, once a round and once for the result, and
    never shuffled. All centroids go to every task, so clusters x dimension is
    bounded (``MOST``).
    """
    if clusters * dimension > MOST:
        raise ValueError(f"clusters x dimension is over {MOST}")
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    kept = own.where((F.size("v") == dimension) & sound(F.col("v")))
    kind = own.schema["id"].dataType.simpleString()
    centroids = first_centroids(kept, clusters, scale, seed)
    if not len(centroids.rows):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = next_centroids(own.select("v"), centroids, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, parts = blocks(batch.column(1), dimension)
            ids, start = batch.column(0).take(pa.array(at)), 0
            for x in parts:
                _, number, d = centroids.nearest(x, scale)
                d = [int(v) if v < LONG else None for v in d.tolist()]
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(x)), pa.array(number.astype(np.int32)), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])
                start += len(x)

    placed = saved(own.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "clusters")
    # a row a cluster comes to the driver; sums as decimals, as many longs may exceed a long
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"), F.count("distance").alias("known")).collect()
    each = {r["cluster"]: int(r["s"]) if r["n"] == r["known"] else None for r in sums}
    total = None if None in each.values() else sum(each.values())
    fit = lambda v: v if v is not None and v < LONG else None
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.rows.tolist()]
    rows = [(k, fit(each[k]), fit(total), digest[k]) for k in sorted(each)]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
