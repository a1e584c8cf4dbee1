"""k-means in whole numbers; each assignment is an Orchard search among the centroids.

Each centroid has the others listed by their distance from it. A search walks the list of the best centroid so far,
goes over to a closer centroid's list as soon as it meets one, never measures a centroid twice, and stops where the
listed distance is more than twice the best one: by the triangle inequality nothing behind is as close.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, slices
from foliant.llm.vectors import matrix, whole


def neighbour_lists(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by squared distance (ties: smaller number), and these distances."""
    apart = np.array([((centres - c) ** 2).sum(axis=1) for c in centres])
    np.fill_diagonal(apart, -1)  # a centroid stands first in its own list, which is then cut off
    order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(apart, order, 1)


def orchard(points: np.ndarray, centres: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, distances measured) of each point; ties go to the smaller number. All in 64-bit integers."""
    order, apart = lists
    n, k = len(points), len(centres)
    best = np.zeros(n, np.int64)
    near = ((points - centres[0]) ** 2).sum(axis=1)
    seen = np.zeros((n, k), bool)
    seen[:, 0] = True
    at, measured = np.zeros(n, np.int64), n
    walking = np.arange(n) if k > 1 else np.zeros(0, np.int64)
    while len(walking):
        row, place = best[walking], at[walking]
        walking = walking[apart[row, place] <= 4 * near[walking]]  # strictly beyond twice the distance: squared, four times
        nxt = order[best[walking], at[walking]]
        at[walking] += 1
        new = ~seen[walking, nxt]
        who, which = walking[new], nxt[new]
        seen[who, which] = True
        far = ((points[who] - centres[which]) ** 2).sum(axis=1)
        measured += len(who)
        won = (far < near[who]) | ((far == near[who]) & (which < best[who]))
        best[who[won]], near[who[won]], at[who[won]] = which[won], far[won], 0
        walking = walking[at[walking] < k - 1]
    return best, near, measured


def _totals(vectors: DataFrame, centres: np.ndarray) -> list:
    """(cluster, n, distance, sums) of each cluster that isn't empty: partial sums leave a task, one row for each cluster."""
    k, dims = centres.shape
    lists = neighbour_lists(centres)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, added = np.zeros(k, np.int64), [0] * k, np.zeros((k, dims), np.int64)
        for batch in batches:
            for part in slices(batch, 8192):
                points = matrix(part.column(1), dims).astype(np.int64)
                best, near, _ = orchard(points, centres, lists)
                n += np.bincount(best, minlength=k)
                for c in np.unique(best):
                    added[c] += points[best == c].sum(axis=0)
                    total[c] += int(near[best == c].sum())
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array([str(total[c]) for c in some], pa.string()), pa.array(added[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total", "added"])

    parts = vectors.mapInArrow(sums, "cluster int, n long, total string, added array<long>")
    wide = "decimal(38,0)"
    each = [F.sum(F.get("added", F.lit(d)).cast(wide)).alias(f"s{d}") for d in range(dims)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast(wide)).alias("total"), *each).collect()


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(assigned: vec_id, cluster, distance, cluster_inertia, inertia) and the centroids that they are assigned to.

    Kept are vectors of ``dims`` components, none null or non-finite; repeated rows count each. The first centroids are
    the k vectors whose ids have the least hashes; a null id hashes as an empty one, and rows of equal ids go by their
    components. With fewer vectors there are fewer centroids, without any no rows. An empty cluster keeps its centroid.
    The driver and each task hold the centroids and their lists, k * (dims + 2 k) numbers, whatever the table's size.
    Sums that leave 64 bits are null.
    """
    held = cut(whole(vectors, id_column, column, scale, dims=dims))
    name = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = held.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    centres = np.array([np.frombuffer(r["v"], "<i4") for r in first], np.int64).reshape(len(first), dims)
    schema = "vec_id long, cluster int, distance long"
    if not first:
        empty = held.sparkSession.createDataFrame([], schema)
        return empty.withColumns({x: F.lit(None).cast("long") for x in ("cluster_inertia", "inertia")}), centres
    for _ in range(rounds):
        for r in _totals(held, centres):
            centres[r["cluster"]] = [int(r[f"s{d}"]) // r["n"] for d in range(dims)]
    lists, fixed = neighbour_lists(centres), centres.copy()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 8192):
                best, near, _ = orchard(matrix(part.column(1), dims).astype(np.int64), fixed, lists)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32)), pa.array(near)], names=["vec_id", "cluster", "distance"])

    found = cut(held.mapInArrow(assign, schema))
    own = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # k rows at most
    fits = lambda n: int(n) if n < 1 << 63 else None
    every = fits(sum(r["total"] for r in own))
    known = held.sparkSession.createDataFrame([(r["cluster"], fits(r["total"]), every) for r in own], "cluster int, cluster_inertia long, inertia long")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), centres


def centroid_digest(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centre.tolist())).encode()).hexdigest()


def clusters(vectors: DataFrame) -> DataFrame:
    """cluster(), with a digest of each vector's centroid."""
    found, centres = cluster(vectors)
    digests = F.array(*(F.lit(centroid_digest(c)) for c in centres)) if len(centres) else F.array().cast("array<string>")
    return found.withColumn("centroid_sha256", F.get(digests, F.col("cluster")))
