"""Seed clustering: points join their nearest seed in order of distance, seeds join each other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.scalars import portable_hash
from cellweave.functions.vectors import nearest
from cellweave.operators.assign import relabel, with_distances
from cellweave.operators.kmeans import farthest_first
from cellweave.operators.order_stats import distributed_rank


def _joined(points: DataFrame, vec: str, seeds: np.ndarray, ids: list, p: float, id_col: str) -> DataFrame:
    """Nearest seed other than the point itself, its distance, and the own seed index of seed points."""
    own = F.coalesce(*[F.when(F.col(id_col) == F.lit(i), F.lit(s)) for s, i in enumerate(ids)], F.lit(-1))
    scored = with_distances(points, vec, seeds, p).withColumn("own_seed", own)
    # a seed is never its own nearest seed
    masked = F.transform("dist", lambda d, i: F.when(i == F.col("own_seed"), F.lit(float("inf"))).otherwise(d))
    scored = scored.withColumn("dist", masked)
    return scored.select(*points.columns, "own_seed", nearest(F.col("dist")).alias("seed"),
                         F.array_min("dist").alias("distance"))


def _components(links: list[tuple[int, int]], s: int) -> dict[int, int]:
    """Closed-up component index per seed (smallest seed first) from at most s links."""
    root = list(range(s))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    order: dict[int, int] = {}
    return {i: order.setdefault(find(i), len(order)) for i in range(s)}


def seed_clustering(points: DataFrame, vec: str, s: int, p: float = 2, id_col: str = "object_id") -> DataFrame:
    """(id, seed, distance, merge_no, cluster): merge order by (distance, id); labels are the
    connected components of the seeds."""
    seeds, ids = farthest_first(points, vec, s, p, id_col)
    joined = _joined(points.select(id_col, vec), vec, seeds, ids, p, id_col)
    links = [(r["own_seed"], r["seed"]) for r in joined.filter("own_seed >= 0").select("own_seed", "seed").collect()]
    labels = _components(links, s)
    ranked = distributed_rank(joined.drop(vec), ["distance", id_col])
    return ranked.select(id_col, "seed", "distance", (F.col("position") - 1).alias("merge_no"),
                         relabel(F.col("seed"), labels).alias("cluster"))


def random_seed_clustering(points: DataFrame, vec: str, s: int, objects: int = -1, seed: int = 0, p: float = 2,
                           id_col: str = "object_id", hash_col: str = "object_id") -> tuple[DataFrame, np.ndarray]:
    """Randomly sampled seeds; only the first ``objects`` joins happen, the rest goes to a dump cluster.

    Seeds that join another seed are merged into the smaller index and removed.
    Returns (id, cluster) and the centroids, the dump centroid being NaN.
    """
    rows = points.select(id_col, vec, portable_hash(hash_col, seed).alias("_h")).orderBy("_h", id_col).limit(s).collect()
    seeds, ids = np.array([r[vec] for r in rows], dtype=float), [r[id_col] for r in rows]
    joined = _joined(points.select(id_col, vec), vec, seeds, ids, p, id_col)
    ranked = distributed_rank(joined.drop(vec), ["distance", id_col])
    if objects >= 0:
        ranked = ranked.withColumn("taken", F.col("position") <= objects)
    else:
        ranked = ranked.withColumn("taken", F.lit(True))
    links = [(r[0], r[1]) for r in ranked.filter("own_seed >= 0 AND taken").select("own_seed", "seed").collect()]
    labels = _components(links, s)
    k = len(set(labels.values()))
    first = {}
    for i in range(s):
        first.setdefault(labels[i], i)
    centroids = np.array([seeds[first[c]] for c in range(k)])
    cluster = F.when(F.col("own_seed") >= 0, relabel(F.col("own_seed"), labels)).when(
        F.col("taken"), relabel(F.col("seed"), labels)).otherwise(F.lit(k))
    out = ranked.select(id_col, cluster.alias("cluster"))
    if objects >= 0 and out.filter(F.col("cluster") == k).limit(1).count():
        centroids = np.vstack([centroids, np.full((1, seeds.shape[1]), np.nan)])
    return out, centroids
