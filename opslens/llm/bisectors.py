"""Centroid clustering in whole numbers by a tournament of bisectors.

A point lies nearer to centroid j than to centroid i < j where twice its product with (c_j - c_i) exceeds |c_j|^2 - |c_i|^2:
the bisector of the pair has an integer normal and threshold, worked out once a round. Each point keeps a winner, at first
centroid 0, and meets the centroids in turn; one sign decides each meeting, and zero is for the smaller number. So k - 1
products name the nearest centroid, and a distance is only computed at the end, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opslens.llm.staging import staged

#: Components are cut off at this size (|x| of 65,536 at the scale of 1,024), so that squared distances of up to 4,096
#: components fit into 64 bits.
LARGEST = 1 << 26


@dataclass(frozen=True)
class Bisectors:
    """Centroids, and for each pair i < j the normal and threshold of what lies nearer to j."""

    centroids: np.ndarray
    normals: np.ndarray
    thresholds: np.ndarray

    @staticmethod
    def of(centroids: Sequence[Sequence[int]]) -> Bisectors:
        c = np.array(centroids, np.int64)
        norms = (c * c).sum(axis=1)
        return Bisectors(c, 2 * (c[None, :, :] - c[:, None, :]), norms[None, :] - norms[:, None])

    def winners(self, points: np.ndarray) -> np.ndarray:
        """The nearest centroid of each point; of equally near ones that with the smallest number."""
        best = np.zeros(len(points), np.int64)
        for j in range(1, len(self.centroids)):
            sign = np.einsum("nd,nd->n", points, self.normals[best, j]) - self.thresholds[best, j]
            best[sign > 0] = j
        return best

    def distances(self, points: np.ndarray, winners: np.ndarray) -> np.ndarray:
        """Squared distance of each point to its winner."""
        apart = points - self.centroids[winners]
        return np.einsum("nd,nd->n", apart, apart)


def _points(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("point").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def scaled(vectors: DataFrame, vector: str, dim: int, scale: int) -> DataFrame:
    """Rows whose vector has ``dim`` components, none null or non-finite, with floor(scale * x) of each as ``point``."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")
    kept = vectors.where(v.isNotNull() & (F.size(v) == dim) & finite)
    return kept.withColumn("point", F.transform(v, whole))


def first_centroids(points: DataFrame, vec_id: str, k: int, prefix: str) -> list[list[int]]:
    """The ``k`` points whose prefixed ids have the smallest checksums; ties go to the smaller components."""
    key = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col(f"`{vec_id}`").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["point"]) for r in points.select(key.alias("key"), "point").orderBy("key", "point").limit(k).collect()]


def _moved(points: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """Each centroid replaced by the floor of its points' mean; one without points stays. Tasks send one row of sums for
    each cluster, which are added up by Spark; k rows reach the driver."""
    bisectors = Bisectors.of(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(bisectors.centroids)
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            found = _points(batch, dim)
            winners = bisectors.winners(found)
            count += np.bincount(winners, minlength=k)
            for cluster in range(k):
                total[cluster] += found[winners == cluster].sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k), pa.int32()), pa.array(count), pa.array(list(total), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = points.select("point").mapInArrow(sums, "cluster int, n long, total array<long>")
    added = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), *(F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)))
    moved = list(centroids)
    for row in added.where("n > 0").collect():
        moved[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dim)]
    return moved


def clustered(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8, dim: int = 64,
              rounds: int = 10, scale: int = 1024, prefix: str = "3:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector kept.

    Kept are vectors of ``dim`` components (4,096 at most), none null or non-finite; a component x counts as
    floor(scale * x), cut off at ``LARGEST``. The first centroids are the vectors whose ids have the smallest checksums, in
    that order (a null id counts as empty text, equal ids go by components, fewer vectors than ``k`` make fewer
    clusters). Each round assigns every vector and moves the centroids. Repeated rows count each and stay. An empty table
    has no rows. Inertias beyond 64 bits are null. Other columns are not carried along, so none can clash.

    The scaled points are written once to the shared folder; a round reads them and shuffles one row for each task and
    cluster. What tasks hold are k (k - 1) normals.
    """
    if not 1 <= dim <= 4096:
        raise ValueError("vectors of 1 to 4096 components can be clustered")
    points = staged(scaled(vectors, vector, dim, scale).select(F.col(f"`{vec_id}`").alias("vec_id"), "point"), "cluster-points")
    centroids = first_centroids(points, "vec_id", k, prefix)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(points, centroids, dim)
    bisectors = Bisectors.of(centroids) if centroids else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _points(batch, dim)
            winners = bisectors.winners(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(winners, pa.int32()), pa.array(bisectors.distances(found, winners))],
                ["vec_id", "cluster", "distance"])

    kind = points.schema["vec_id"].dataType.simpleString()
    near = staged(points.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "cluster-rows")
    per_cluster = {r["cluster"]: int(r["d"]) for r in near.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows at most
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    as_long = lambda n: F.lit(str(n)).cast("decimal(38,0)").try_cast("bigint")
    by_number = lambda values, kind: F.get(F.array(*values).cast(f"array<{kind}>"), F.col("cluster"))
    return near.select(
        "vec_id", "cluster", "distance",
        by_number([as_long(per_cluster.get(c, 0)) for c in range(len(centroids))], "bigint").alias("cluster_inertia"),
        as_long(sum(per_cluster.values())).alias("inertia"),
        by_number([F.lit(digest(c)) for c in centroids], "string").alias("centroid_sha256"))
