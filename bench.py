"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from cellweave import fixtures  # noqa: E402
from cellweave.functions.scalars import uniform01  # noqa: E402
from cellweave.operators import kmeans  # noqa: E402
from cellweave.queries import registry  # noqa: E402
from cellweave.session import local_session  # noqa: E402

HEADLINE = [
    "qc_valid_cells", "penetrance", "control_split", "population", "z_score", "robust_stats", "edf_distance_matrix",
    "kmeans_lloyd", "library_kmeans", "kd_tree", "nearest_centroid", "silhouette", "soft_profiles", "smoothed_profiles",
    "distance_map_quadratic_chi", "mahalanobis_group_map", "random_split_distance", "duplicate_at_random",
]


def uniform_points(spark, sf_dir: str, p: int):
    """One point in [-1, 1]^p per order, coordinates hashed from its key."""
    orders = fixtures.table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("object_id"))
    coords = [uniform01("object_id", 7 + i) * 2.0 - 1.0 for i in range(p)]
    return orders.select("object_id", F.array(*coords).alias("vec"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    fixtures.table(spark, sf_dir, "lineitem").agg(F.sum("l_quantity")).collect()
    seconds = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        registry.QUERIES[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    notes = {}
    if not only or "kmeans_uniform" in only:
        pts = uniform_points(spark, sf_dir, 50).limit(100_000).repartition(spark.sparkContext.defaultParallelism).persist()
        n = pts.count()
        for k in (20, 50):
            start = time.perf_counter()
            seeds = kmeans.farthest_first(pts, "vec", k)[0]
            seeded = time.perf_counter()
            fit = kmeans.lloyd(pts, "vec", seeds, swap_threshold=0, max_iter=10_000, refill=False)
            name = f"kmeans_uniform_p50_k{k}"
            seconds[name] = round(time.perf_counter() - start, 3)
            notes[name] = {"n": n, "rounds": fit.rounds, "seeding": round(seeded - start, 3),
                           "per_round": round((time.perf_counter() - seeded) / fit.rounds, 3)}
        pts.unpersist()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "notes": notes}))
    spark.stop()


if __name__ == "__main__":
    main()
