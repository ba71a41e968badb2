"""k-means family: farthest-first seeds, Lloyd rounds, medians, robust centres, random centroids.

Every round is one table-wide aggregate. Only k×p numbers come back to the
driver, and the next round gets them as literals, so lineage does not grow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.partials import PARTS, block_sums, list_matrix, matrix_list, packed_blocks
from cellweave.functions.scalars import MODULUS
from cellweave.functions.vectors import balanced_sum, centroid_distances, distance_matrix, nearest_rows, total
from cellweave.model import UNROLL_TERMS, check_model_size
from cellweave.operators.assign import assign_nearest
from cellweave.operators.member_medians import member_medians
from cellweave.operators.order_stats import median_and_mad

#: Points a seeding pass brings to the driver.
FAR_POINTS = 2048

#: Distances of a matrix of points to centres.
DistanceFn = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Clustering:
    """Centroids (k×p), objective and changed points per round."""

    centroids: np.ndarray
    inertia: list[float] = field(default_factory=list)
    changed: list[int] = field(default_factory=list)
    rounds: int = 0


def _farthest(scored: DataFrame, count: int) -> list[dict]:
    """The ``count`` rows (i, v, d) of largest d, ties to the lowest i. One task cuts the rows of all others down; a plain
    collect would send so many rows of each partition to the driver."""
    return scored.orderBy(F.desc("d"), "i").limit(count).toArrow().to_pylist()


def farthest_first(points: DataFrame, vec: str, k: int, p: float = 2, id_col: str = "object_id",
                   first: np.ndarray | None = None) -> tuple[np.ndarray, list]:
    """Seeds: the lowest id, then k−1 times the point farthest from its nearest seed (ties to the lowest id).

    Each pass brings FAR_POINTS points back, which settle as many seeds as no other point could be. Returns the k×p
    seeds and their ids.
    """
    if first is None:
        row = points.agg(F.min_by(F.struct(F.col(id_col).alias("i"), F.col(vec).alias("v")), id_col)).first()[0]
        seeds, ids = [np.array(row["v"], dtype=float)], [row["i"]]
    else:
        seeds, ids = [np.asarray(first, dtype=float)], [None]
    while len(seeds) < k:
        check_model_size(len(seeds) * len(seeds[0]), "seeds")
        d = F.array_min(centroid_distances(F.col(vec), np.array(seeds), p))
        far = _farthest(points.select(F.col(id_col).alias("i"), F.col(vec).alias("v"), d.alias("d")), FAR_POINTS)
        # No other point is farther than the last of these, and distances only fall: while the farthest of
        # them is beyond that, it is the farthest of all.
        x, low = np.array([r["v"] for r in far], dtype=float), np.array([r["d"] for r in far])
        bound = low[-1] if len(far) == FAR_POINTS else -np.inf
        fresh = 0
        while len(seeds) < k:
            at = min(np.flatnonzero(low == low.max()), key=lambda r: far[r]["i"])
            if fresh and low[at] <= bound:
                break
            seeds.append(x[at])
            ids.append(far[at]["i"])
            fresh += 1
            low = np.minimum(low, distance_matrix(x, x[at:at + 1], p)[:, 0])
    return np.array(seeds), ids


def member_sums(x: np.ndarray, centroids: np.ndarray, previous: np.ndarray | None, p: float, weights: np.ndarray | None) -> np.ndarray:
    """Per cluster: p coordinate sums, count, Σd², points that changed since ``previous``. Runs inside tasks."""
    k, n = centroids.shape
    best, low = nearest_rows(x, centroids, p, weights)
    moved = np.ones(len(x)) if previous is None else (nearest_rows(x, previous, p, weights)[0] != best).astype(float)
    return _column_sums(best, [*x.T, np.ones(len(x)), low * low, moved], k)


def joint_sums(x: np.ndarray, fits: list["LloydFit"]) -> np.ndarray:
    """``member_sums`` of all fits, stacked. Fits that stand on the same centres share the search for the nearest ones."""
    nearest: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    sums: dict[tuple, np.ndarray] = {}
    moved: dict[tuple, np.ndarray] = {}

    def found(c: np.ndarray, f: LloydFit) -> tuple[tuple, np.ndarray, np.ndarray]:
        key = (c.shape, c.tobytes(), f.p, None if f.weights is None else np.asarray(f.weights, dtype=float).tobytes())
        if key not in nearest:
            nearest[key] = nearest_rows(x, c, f.p, f.weights)
        return key, *nearest[key]

    out = []
    for f in fits:
        key, best, low = found(f.c, f)
        if key not in sums:
            sums[key] = _column_sums(best, [*x.T, np.ones(len(x)), low * low], len(f.c))
        if f.swap_threshold is None or f.previous is None:
            changed = sums[key][:, -2]
        else:
            before, old, _ = found(f.previous, f)
            if (key, before) not in moved:
                moved[key, before] = _column_sums(best, [(old != best).astype(float)], len(f.c))[:, 0]
            changed = moved[key, before]
        out.append(np.column_stack([sums[key], changed]))
    return np.vstack(out)


def _column_sums(best: np.ndarray, columns: list[np.ndarray], k: int) -> np.ndarray:
    return np.stack([np.bincount(best, weights=v, minlength=k) for v in columns], axis=1)


def farthest_points(points: DataFrame, vec: str, centroids: np.ndarray, count: int, p: float,
                     weights: np.ndarray | None, id_col: str) -> list[np.ndarray]:
    d = F.array_min(centroid_distances(F.col(vec), centroids, p, weights))
    rows = _farthest(points.select(F.col(id_col).alias("i"), F.col(vec).alias("v"), d.alias("d")), count)
    return [np.array(r["v"], dtype=float) for r in rows]


def lloyd(points: DataFrame, vec: str, start: np.ndarray, p: float = 2, max_iter: int = 300, tol: float = 1e-4,
          swap_threshold: int | None = None, weights: np.ndarray | None = None, refill: bool = True,
          id_col: str = "object_id") -> Clustering:
    """Lloyd rounds with Minkowski-p assignment and mean update.

    Stops when the summed squared centre shift falls below ``tol``, or, if a
    swap threshold is given, when at most that many points changed cluster. An
    empty cluster moves to a farthest point, or keeps its centre without ``refill``.
    Points are packed into matrices once; each round is one pass over those.
    """
    fit = LloydFit(start, p, tol, swap_threshold, weights, refill)
    lloyd_rounds(points, vec, [fit], max_iter, id_col)
    return fit.result


class LloydFit:
    """Centres of one fit, those of the round before, and when it stops."""

    def __init__(self, start: np.ndarray, p: float = 2, tol: float = 1e-4, swap_threshold: int | None = None,
                 weights: np.ndarray | None = None, refill: bool = True):
        self.c, self.previous, self.done = np.array(start, dtype=float), None, False
        self.p, self.tol, self.swap_threshold, self.weights, self.refill = p, tol, swap_threshold, weights, refill
        self.result = Clustering(self.c)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return member_sums(x, self.c, self.previous if self.swap_threshold is not None else None, self.p, self.weights)

    def advance(self, sums: np.ndarray, farthest: Callable[[np.ndarray, int], list[np.ndarray]]) -> None:
        """Next centres from the sums of a round; ``farthest`` gives so many points far from all centres."""
        c, n, result = self.c, self.c.shape[1], self.result
        count = sums[:, n]
        result.inertia.append(float(sums[:, n + 1].sum()))
        result.changed.append(int(sums[:, n + 2].sum()))
        result.rounds += 1
        new = np.where(count[:, None] > 0, sums[:, :n] / np.maximum(count, 1)[:, None], c)
        empty = np.flatnonzero(count == 0)
        if self.refill and len(empty):
            for slot, far in zip(empty, farthest(c, len(empty))):
                new[slot] = far
        if self.swap_threshold is not None and self.previous is not None and result.changed[-1] <= self.swap_threshold:
            self.done = True
            return
        shift = float(((new - c) ** 2).sum())
        self.previous, self.c = c, new
        result.centroids = new
        self.done = self.swap_threshold is None and shift < self.tol


def lloyd_rounds(points: DataFrame, vec: str, fits: list[LloydFit], max_iter: int, id_col: str = "object_id") -> None:
    """Run all fits to their ends, each round one pass over the packed points for all that still move."""
    blocks = packed_blocks(points, vec).persist(StorageLevel.MEMORY_AND_DISK)
    run_rounds(blocks, fits[0].c.shape[1], fits, max_iter, joint_sums,
               lambda f: lambda c, count: farthest_points(points, vec, c, count, f.p, f.weights, id_col))
    blocks.unpersist()


def run_rounds(blocks: DataFrame, width: int, fits: list[LloydFit], max_iter: int,
               sums_of: Callable[[np.ndarray, list[LloydFit]], np.ndarray],
               farthest_of: Callable[[LloydFit], Callable[[np.ndarray, int], list[np.ndarray]]]) -> None:
    """Rounds over blocks of ``width`` columns, of which ``sums_of`` makes the stacked sums of the fits that still move."""
    n = fits[0].c.shape[1]
    check_model_size(sum(f.c.size for f in fits), "centroids")
    many = blocks.rdd.getNumPartitions() > PARTS
    for _ in range(max_iter):
        live = [f for f in fits if not f.done]
        if not live:
            break
        sums = block_sums(blocks, width, lambda x: sums_of(x, live), sum(len(f.c) for f in live), n + 3, many)
        ends = np.cumsum([len(f.c) for f in live])
        for f, own in zip(live, np.split(sums, ends[:-1])):
            f.advance(own, farthest_of(f))


def kmeans(points: DataFrame, vec: str, k: int, p: float = 2, start: np.ndarray | None = None, **kw) -> Clustering:
    seeds = farthest_first(points, vec, k, p)[0] if start is None else start
    return lloyd(points, vec, seeds, p, **kw)


def swap_kmeans(points: DataFrame, vec: str, k: int, threshold: int = 0, start: np.ndarray | None = None,
                **kw) -> Clustering:
    """Squared-Euclid variant that stops by changed points; empty clusters keep their centre."""
    seeds = farthest_first(points, vec, k)[0] if start is None else start
    return lloyd(points, vec, seeds, 2, swap_threshold=threshold, refill=False, **kw)


def _median_rounds(points: DataFrame, vec: str, start: np.ndarray, distances: DistanceFn, max_iter: int,
                   swap_threshold: int) -> Clustering:
    """Points are packed once; a round is one pass that assigns and brackets the medians, and the passes that settle them."""
    c = np.array(start, dtype=float)
    result = Clustering(c)
    previous = None
    blocks = packed_blocks(points, vec).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(max_iter):
        medians, inertia, changed = member_medians(blocks, c, previous, distances)
        result.inertia.append(inertia)
        result.changed.append(changed)
        result.rounds += 1
        if previous is not None and changed <= swap_threshold:
            break
        previous, c = c, np.where(np.isnan(medians), c, medians)
        result.centroids = c
    blocks.unpersist()
    return result


def kmedians(points: DataFrame, vec: str, k: int, p: float = 2, start: np.ndarray | None = None,
             swap_threshold: int = 0, max_iter: int = 100) -> Clustering:
    """Centres are per-feature medians of the members; an empty cluster keeps its centre."""
    seeds = farthest_first(points, vec, k, p)[0] if start is None else start
    return _median_rounds(points, vec, seeds, lambda x, c: distance_matrix(x, c, p), max_iter, swap_threshold)


def robust_distances(vec: Column, centroids: np.ndarray, mad: np.ndarray, sharpness: float) -> Column:
    """Σ over features of 1 − exp(−s·|x − c|/MAD); features without spread do not count."""
    c, m = np.asarray(centroids, dtype=float), np.asarray(mad, dtype=float)
    used = np.flatnonzero(m > 0)
    if c.shape[0] * len(used) <= UNROLL_TERMS:
        return F.array(*[
            total([F.lit(1.0) - F.exp(F.abs(vec[int(i)] - F.lit(float(row[i]))) * F.lit(float(-sharpness / m[i])))
                   for i in used]) for row in c])

    @F.arrow_udf("array<double>")
    def distances(v: pa.Array) -> pa.Array:
        return matrix_list(robust_rows(list_matrix(v).reshape(-1, c.shape[1]), c, m, sharpness))

    return distances(vec)


def robust_rows(x: np.ndarray, centroids: np.ndarray, mad: np.ndarray, sharpness: float) -> np.ndarray:
    """``robust_distances`` of a matrix of points. Runs inside tasks."""
    used = np.flatnonzero(mad > 0)
    out = [balanced_sum(1.0 - np.exp(np.abs(x[:, used] - row[used]) * (-sharpness / mad[used]))) for row in centroids]
    return np.stack(out, axis=1)


def feature_spread(points: DataFrame, vec: str, p: int) -> np.ndarray:
    """MAD of every vector position over all points."""
    long = points.select(F.posexplode(vec).alias("feature", "value"))
    out = np.zeros(p)
    for r in median_and_mad(long, ["feature"], "value").collect():
        out[r["feature"]] = r["mad"]
    return out


def robust_centres(points: DataFrame, vec: str, k: int, sharpness: float = 1.0, swap_threshold: int = 0,
                   start: np.ndarray | None = None, max_iter: int = 100) -> tuple[Clustering, np.ndarray]:
    seeds = farthest_first(points, vec, k)[0] if start is None else np.asarray(start, dtype=float)
    mad = feature_spread(points, vec, seeds.shape[1])
    out = _median_rounds(points, vec, seeds, lambda x, c: robust_rows(x, c, mad, sharpness), max_iter, swap_threshold)
    return out, mad


def spread_weights(points: DataFrame, vec: str, p: int) -> np.ndarray:
    """MAD per feature scaled to [0, 1]; equal spreads give weight 1."""
    mad = feature_spread(points, vec, p)
    low, high = mad.min(), mad.max()
    return np.ones(p) if high == low else (mad - low) / (high - low)


def weighted_kmeans(points: DataFrame, vec: str, k: int, p: float = 2, start: np.ndarray | None = None,
                    max_iter: int = 150, **kw) -> tuple[Clustering, np.ndarray]:
    """Lloyd on distances weighted by the spread of each feature over all points."""
    seeds = farthest_first(points, vec, k, p)[0] if start is None else np.asarray(start, dtype=float)
    weights = spread_weights(points, vec, seeds.shape[1])
    return lloyd(points, vec, seeds, p, max_iter=max_iter, weights=weights, **kw), weights


def random_centroids(points: DataFrame, vec: str, k: int, p: int, seed: int = 0) -> np.ndarray:
    """k seeded uniform points in the box of the data."""
    v = F.col(vec)
    row = points.agg(*[f(v[i]) for i in range(p) for f in (F.min, F.max)]).first()
    low, high = np.array(row[0::2], dtype=float), np.array(row[1::2], dtype=float)
    u = np.empty((k, p))
    for j in range(k):
        for i in range(p):
            x = (j * 7919 + i * 104729 + 12345 + seed * 1013904223) % MODULUS
            u[j, i] = (((x * x) % MODULUS) * 48271 + x) % MODULUS / MODULUS
    return low + u * (high - low)


def library_kmeans(points: DataFrame, vec: str, k: int, max_iter: int = 300, seed: int = 0) -> tuple[np.ndarray, float]:
    model = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="_v").fit(points.select(array_to_vector(vec).alias("_v")))
    return np.array(model.clusterCenters()), float(model.summary.trainingCost)


def gaussian_mixture(points: DataFrame, vec: str, k: int, max_iter: int = 200, seed: int = 0) -> DataFrame:
    """Adds ``cluster`` (most likely component) and ``probability``."""
    with_v = points.withColumn("_v", array_to_vector(vec))
    model = GaussianMixture(k=k, maxIter=max_iter, seed=seed, featuresCol="_v", predictionCol="cluster",
                            probabilityCol="_prob").fit(with_v)
    return model.transform(with_v).withColumn("probability", F.array_max(vector_to_array("_prob"))).drop("_v", "_prob")


def assign(points: DataFrame, vec: str, clustering: Clustering, p: float = 2,
           weights: np.ndarray | None = None) -> DataFrame:
    return assign_nearest(points, vec, clustering.centroids, p, weights)

