"""Assignment of points to clusters and everything derived from a partition."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.vectors import centroid_distances, distance_matrix, literal_array, nearest
from cellweave.model import check_model_size

UNASSIGNED = -1


def with_distances(points: DataFrame, vec: str, centroids: np.ndarray, p: float = 2,
                   weights: np.ndarray | None = None, out: str = "dist") -> DataFrame:
    """Distance to every centroid as an array column. Map-only."""
    return points.withColumn(out, centroid_distances(F.col(vec), centroids, p, weights))


def assign_nearest(points: DataFrame, vec: str, centroids: np.ndarray, p: float = 2,
                   weights: np.ndarray | None = None) -> DataFrame:
    """Adds ``dist`` and ``cluster`` (ties to the lowest index)."""
    return with_distances(points, vec, centroids, p, weights).withColumn("cluster", nearest(F.col("dist")))


def assign_min_ess(points: DataFrame, vec: str, centroids: np.ndarray, sizes: Sequence[int]) -> DataFrame:
    """Cluster whose error sum of squares grows least when the point joins it."""
    grow = literal_array([n / (n + 1.0) for n in sizes])
    cost = F.zip_with("dist", grow, lambda d, g: g * d * d)
    return with_distances(points, vec, centroids).withColumn("ess", cost).withColumn("cluster", nearest(F.col("ess")))


def centroids_of(assigned: DataFrame, vec: str, p: int, cluster: str = "cluster") -> DataFrame:
    """Mean vector and size per cluster: (cluster, n, centroid)."""
    v = F.col(vec)
    return assigned.filter(F.col(cluster) >= 0).groupBy(F.col(cluster).alias("cluster")).agg(
        F.count("*").alias("n"), F.array(*[F.avg(v[i]) for i in range(p)]).alias("centroid"))


def centroid_matrix(table: DataFrame, k: int, p: int, check: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Driver-side centroids (k×p, NaN rows for empty clusters) and sizes."""
    if check:
        check_model_size(k * p, "centroids")
    out, sizes = np.full((k, p), np.nan), np.zeros(k, dtype=np.int64)
    for r in table.collect():
        out[r["cluster"]] = r["centroid"]
        sizes[r["cluster"]] = r["n"]
    return out, sizes


def intra_cluster_distances(assigned: DataFrame, vec: str, centroids: np.ndarray, p: float = 2) -> DataFrame:
    """Distance of every point to the centroid of its own cluster (NaN if unassigned)."""
    own = F.when(F.col("cluster") >= 0, F.try_element_at("_d", (F.col("cluster") + 1).cast("int"))).otherwise(
        F.lit(float("nan")))
    return with_distances(assigned, vec, centroids, p, out="_d").withColumn("own_distance", own).drop("_d")


def inter_cluster_ess(table: DataFrame) -> DataFrame:
    """Growth of the error sum of squares when clusters i and j join: nᵢnⱼ/(nᵢ+nⱼ)·‖cᵢ−cⱼ‖²."""
    from cellweave.operators.blocks import pair_rows

    a = table.select(F.col("cluster").alias("cluster_i"), F.col("n").alias("_ni"), F.col("centroid").alias("_ci"))
    b = table.select(F.col("cluster").alias("cluster_j"), F.col("n").alias("_nj"), F.col("centroid").alias("_cj"))
    pairs = pair_rows(a, b, "cluster_i", "cluster_j")
    sq = F.aggregate(F.zip_with("_ci", "_cj", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return pairs.select("cluster_i", "cluster_j",
                        (F.col("_ni") * F.col("_nj") / (F.col("_ni") + F.col("_nj")) * sq).alias("ess_change"))


def relabel(column: Column, mapping: dict[int, int], default: int = UNASSIGNED) -> Column:
    """Old index → new index through a literal map of at most k entries."""
    entries = [F.lit(int(x)) for pair in mapping.items() for x in pair]
    if not entries:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*entries), column), F.lit(default))


def cluster_sizes(assigned: DataFrame) -> dict[int, int]:
    return {r["cluster"]: r["count"] for r in assigned.filter("cluster >= 0").groupBy("cluster").count().collect()}


# Clusterings whose points are all reassigned after small clusters were discarded.
REASSIGN_ALL = ("k-means", "k-medians", "k-medoids", "ward", "single", "average", "complete")


def discard_small(assigned: DataFrame, vec: str, p_features: int, min_size: int, reassign_all: bool = False,
                  p: float = 2) -> tuple[DataFrame, np.ndarray]:
    """Drop clusters below ``min_size``, close up the indices, recompute centroids, then send the
    discarded points (or all points) to the nearest survivor."""
    sizes = cluster_sizes(assigned)
    kept = sorted(c for c, n in sizes.items() if n >= min_size)
    mapping = {c: i for i, c in enumerate(kept)}
    closed = assigned.withColumn("cluster", relabel(F.col("cluster"), mapping))
    if not kept:
        return closed, np.empty((0, p_features))
    centroids, _ = centroid_matrix(centroids_of(closed, vec, p_features), len(kept), p_features)
    scored = with_distances(closed, vec, centroids, p)
    new = nearest(F.col("dist"))
    if not reassign_all:
        new = F.when(F.col("cluster") < 0, new).otherwise(F.col("cluster"))
    return scored.withColumn("cluster", new), centroids


def dissolve_small(assigned: DataFrame, vec: str, centroids: np.ndarray, min_size: int = 200,
                   p: float = 2) -> tuple[DataFrame, list[int]]:
    """Dissolve clusters below ``min_size`` in index order, one at a time; members go to the nearest
    remaining centroid, centroids stay.

    Alive sets only shrink, so a point whose own cluster is gone always sits with
    the nearest centroid still alive: each step is one count of the members of
    one cluster by their next destination, and only k counters reach the driver.
    """
    k = len(centroids)
    scored = with_distances(assigned, vec, centroids, p).persist()
    sizes = np.zeros(k, dtype=np.int64)
    for c, n in cluster_sizes(scored).items():
        sizes[c] = n
    alive = [True] * k
    gone: list[int] = []

    def current() -> Column:
        masked = F.array(*[F.col("dist")[i] if alive[i] else F.lit(float("inf")) for i in range(k)])
        kept = [i for i in range(k) if alive[i]]
        return F.when(F.col("cluster").isin(kept), F.col("cluster")).otherwise(nearest(masked))

    while sum(alive) > 1:
        small = [i for i in range(k) if alive[i] and sizes[i] < min_size]
        if not small:
            break
        c = small[0]
        members = scored.filter(current() == c)
        alive[c] = False
        if sizes[c]:
            for r in members.groupBy(current().alias("to")).count().collect():
                sizes[r["to"]] += r["count"]
        sizes[c] = 0
        gone.append(c)
    left = {c: i for i, c in enumerate(i for i in range(k) if alive[i])}
    scored.unpersist()
    return scored.withColumn("cluster", relabel(current(), left)), gone


def merge_clusters(assigned: DataFrame, vec: str, p: int, keep: int, drop: int, k: int) -> tuple[DataFrame, np.ndarray]:
    """Members of ``drop`` join ``keep``; indices above close up; only that centroid is new."""
    moved = {c: (c if c < drop else c - 1) for c in range(k) if c != drop}
    moved[drop] = moved[keep]
    merged = assigned.withColumn("cluster", relabel(F.col("cluster"), moved))
    centroids, _ = centroid_matrix(centroids_of(merged, vec, p), k - 1, p)
    return merged, centroids


def merge_nearest_centroids(centroids: np.ndarray, sizes: Sequence[int], target: int,
                            p: float = 2) -> tuple[np.ndarray, dict[int, int]]:
    """Merge the two nearest of k centroids (size-weighted mean) until ``target`` are left.

    Works on the k×p model only; returns the new centroids and old → new index.
    """
    groups = [[i] for i in range(len(centroids))]
    c, n = np.array(centroids, dtype=float), np.array(sizes, dtype=float)
    while len(c) > max(target, 1):
        d = distance_matrix(c, c, p)
        d[np.tril_indices(len(c))] = np.inf
        i, j = divmod(int(np.argmin(d)), len(c))
        total = n[i] + n[j]
        c[i] = (n[i] * c[i] + n[j] * c[j]) / total if total else (c[i] + c[j]) / 2
        n[i] = total
        groups[i] += groups[j]
        c, n = np.delete(c, j, axis=0), np.delete(n, j)
        del groups[j]
    return c, {old: new for new, g in enumerate(groups) for old in g}


def explode_distances(scored: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Long form (keep…, cluster, distance); ∞ for unclustered rows stays ∞."""
    return scored.select(*keep, F.posexplode("dist").alias("cluster", "distance"))


def with_cluster_distances(cells: DataFrame, vec: str, centroids: np.ndarray, clustered: Column,
                           p: float = 2) -> DataFrame:
    """clusterDist array for every cell: ∞ everywhere when the cell is not clustered."""
    nothing = literal_array([float("inf")] * len(centroids))
    return cells.withColumn("dist", F.when(clustered, centroid_distances(F.col(vec), centroids, p)).otherwise(nothing))

