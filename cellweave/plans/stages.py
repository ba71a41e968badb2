"""Stages as pure functions, and the two drivers: clustering and profiling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from cellweave.config import ClusterConfig, FilterConfig, ProfileConfig, QcConfig
from cellweave.functions.vectors import distance_matrix
from cellweave.operators import assign, controls, edf, grouping, kdtree, kmeans, linkage, masks, normalize, profiles, quality
from cellweave.operators import seeds as seed_ops
from cellweave.operators import silhouette, validation
from cellweave.session import cut_lineage

METHODS = ("k-means", "swap-k-means", "k-medians", "k-medoids", "weighted-k-means", "robust-centres", "lloyd", "random",
           "kd-tree", "seed", "random-seed", "single", "ward", "average", "complete", "weighted", "mahalanobis", "gaussian-mixture",
           "library-k-means")


def qc_stage(objects: DataFrame, images: DataFrame, cfg: QcConfig, features: Sequence[str] = ()) -> DataFrame:
    cells = quality.run_quality_control(objects, images, cfg)
    return masks.reject_bad_features(cells, features) if features else cells


def filter_stage(cells: DataFrame, cfg: FilterConfig, components: int | None = None) -> controls.ControlSplit:
    """Control split; with ``components`` the distance is taken on independent components."""
    if not components:
        return controls.split_controls(cells, cfg)
    from cellweave.functions.vectors import linear_map, vector
    ref = cells.filter(F.col("is_valid") & F.col("treatment").isin(list(cfg.control_treatments))).select(
        vector(cfg.features).alias("_vec"))
    mean, unmix = normalize.ica_model(ref, "_vec", len(cfg.features), components)
    projected = linear_map(vector(cfg.features), unmix, mean)
    slim = FilterConfig(tuple(cfg.features[:components]), cfg.control_treatments, cfg.cutoff_threshold,
                        cfg.cutoff_fraction, cfg.mode, cfg.run_mahal_dist, cfg.valid_only)
    return controls.split_controls(cells, slim, vec=projected)


@dataclass(frozen=True)
class ClusterResult:
    cells: DataFrame
    centroids: np.ndarray
    scaling: normalize.Scaling
    tree: kdtree.Node | None = None


def _fit(points: DataFrame, p: int, cfg: ClusterConfig, id_col: str) -> tuple[DataFrame, np.ndarray, kdtree.Node | None]:
    """Dispatch by method; the result carries ``cluster`` for every point."""
    m, k = cfg.method, cfg.k
    tree = None
    if m in ("k-means", "mahalanobis"):
        c = kmeans.kmeans(points, "vec", k, cfg.p, max_iter=cfg.max_iter, tol=cfg.tol, id_col=id_col).centroids
    elif m == "swap-k-means":
        c = kmeans.swap_kmeans(points, "vec", k, cfg.swap_threshold, max_iter=cfg.max_iter, id_col=id_col).centroids
    elif m == "lloyd":
        c = kmeans.lloyd(points, "vec", kmeans.farthest_first(points, "vec", k, cfg.p, id_col)[0], cfg.p, cfg.max_iter,
                         swap_threshold=0, refill=False, id_col=id_col).centroids
    elif m == "k-medians":
        c = kmeans.kmedians(points, "vec", k, cfg.p, swap_threshold=cfg.swap_threshold, max_iter=cfg.max_iter).centroids
    elif m == "k-medoids":
        c = silhouette.kmedoids(points, "vec", k, cfg.p, cfg.max_iter, id_col)[0]
    elif m == "weighted-k-means":
        fit, weights = kmeans.weighted_kmeans(points, "vec", k, cfg.p, id_col=id_col)
        return assign.assign_nearest(points, "vec", fit.centroids, cfg.p, weights).drop("dist"), fit.centroids, None
    elif m == "robust-centres":
        c = kmeans.robust_centres(points, "vec", k, cfg.sharpness, cfg.swap_threshold)[0].centroids
    elif m == "random":
        c = kmeans.random_centroids(points, "vec", k, p, cfg.seed)
    elif m == "library-k-means":
        c = kmeans.library_kmeans(points, "vec", k, cfg.max_iter, cfg.seed)[0]
    else:
        if m == "kd-tree":
            tree = kdtree.build_tree(points, "vec", p, cfg.max_depth)
            labelled = kdtree.partition(points, "vec", tree)
        elif m == "seed":
            labelled = points.join(seed_ops.seed_clustering(points, "vec", k, cfg.p, id_col).select(id_col, "cluster"), id_col)
        elif m == "random-seed":
            out, _ = seed_ops.random_seed_clustering(points, "vec", k, seed=cfg.seed, p=cfg.p, id_col=id_col, hash_col="seed_key")
            labelled = points.join(out, id_col)
        elif m == "gaussian-mixture":
            labelled = kmeans.gaussian_mixture(points, "vec", k, seed=cfg.seed).drop("probability")
        elif m in ("single", "ward"):
            labelled = _cut_points(points, m, k, id_col)
        elif m in ("average", "complete", "weighted"):
            labelled = _cut_micro(points, m, k, cfg, id_col)
        else:
            raise ValueError(f"no such clustering method: {m}")
        labelled = cut_lineage(labelled.select(*points.columns, "cluster"))
        count = labelled.agg(F.max("cluster")).first()[0] + 1
        return labelled, assign.centroid_matrix(assign.centroids_of(labelled, "vec", p), count, p)[0], tree
    return assign.assign_nearest(points, "vec", c, cfg.p).drop("dist"), c, None


def _cut_points(points: DataFrame, method: str, k: int, id_col: str) -> DataFrame:
    """Tree cut of points under dense long ids."""
    from cellweave.operators.order_stats import distributed_rank
    ids = cut_lineage(distributed_rank(points, [id_col], name="_no"))
    if method == "single":
        merges = linkage.single_linkage(ids, "vec", "_no")
    else:
        ranked = distributed_rank(linkage.ward_linkage(ids, "vec", "_no"), ["distance", "round", "a", "b"])
        merges = ranked.select((F.col("position") - 1).alias("merge_no"), F.col("a").alias("lo"), F.col("b").alias("hi"), "distance")
    return ids.join(linkage.cut_single(ids, merges, k, "_no"), "_no").drop("_no")


def _cut_micro(points: DataFrame, method: str, k: int, cfg: ClusterConfig, id_col: str) -> DataFrame:
    """Tree cut of the centroids of ``cfg.micro`` small clusters; a point goes where its small cluster goes.

    These linkages need the distances of all pairs, so they start from small clusters, each counting once; with no more
    distinct points than that, each point is a small cluster of its own.
    """
    seeds = kmeans.farthest_first(points, "vec", cfg.micro, cfg.p, id_col)[0]
    centres = np.unique(kmeans.lloyd(points, "vec", seeds, cfg.p, cfg.max_iter, swap_threshold=0, refill=False, id_col=id_col).centroids, axis=0)
    d, n = distance_matrix(centres, centres, cfg.p), len(centres)
    spark = points.sparkSession
    table = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(n) for j in range(n)], "row_id bigint, col_id bigint, distance double")
    cut = linkage.cut_tree(linkage.ordered_merges(linkage.table_linkage(table, method)), spark.range(n), k)
    names = {r["id"]: r["cluster"] for r in cut.collect()}  # at most ``cfg.micro`` rows
    near = assign.assign_nearest(points, "vec", centres, cfg.p).drop("dist")
    return near.withColumn("cluster", assign.relabel(F.col("cluster"), names))


def run_clustering(cells: DataFrame, features: Sequence[str], controls_: Sequence[str], cfg: ClusterConfig,
                   group: str | None = None, id_col: str = "object_id") -> ClusterResult:
    """Non-control cells of a group: z-score by controls, cluster, clean up small clusters, ClusterID column.

    ``group`` is an optional SQL predicate. Cells outside keep ClusterID −1.
    """
    chosen = cells.filter("is_valid AND is_non_control")
    if group:
        chosen = chosen.filter(group)
    reference = cells.filter(F.col("is_valid") & F.col("treatment").isin(list(controls_)))
    points, scaling = normalize.normalise(chosen, reference, features)
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    p = len(scaling.features)
    labelled, centroids, tree = _fit(points, p, cfg, id_col)
    if cfg.discard_size > 1 and tree is None:
        cleaned, kept = assign.discard_small(labelled, "vec", p, cfg.discard_size, cfg.method in assign.REASSIGN_ALL, cfg.p)
        if len(kept):
            labelled, centroids = cleaned.drop("dist"), kept
    if cfg.target is not None and len(centroids) > cfg.target:
        sizes = assign.cluster_sizes(labelled)
        centroids, mapping = assign.merge_nearest_centroids(
            centroids, [sizes.get(i, 0) for i in range(len(centroids))], cfg.target, cfg.p)
        labelled = labelled.withColumn("cluster", assign.relabel(F.col("cluster"), mapping))
    if cfg.dissolve_size > 1 and tree is None and len(centroids) > 1:
        labelled, gone = assign.dissolve_small(labelled, "vec", centroids, cfg.dissolve_size, cfg.p)
        centroids = np.array([c for i, c in enumerate(centroids) if i not in gone])
        labelled = labelled.drop("dist")
    return ClusterResult(labelled, centroids, scaling, tree)


def score_cells(cells: DataFrame, scaling: normalize.Scaling, centroids: np.ndarray, p: float = 2,
                tree: kdtree.Node | None = None) -> DataFrame:
    """Saved model on new cells: z-score, nearest centroid or tree leaf, distance to every centroid. Map-only."""
    scored = cells.withColumn("vec", scaling.vector())
    if tree is not None:
        return kdtree.partition(assign.with_distances(scored, "vec", centroids, p), "vec", tree)
    return assign.assign_nearest(scored, "vec", centroids, p)


def run_profiling(result: ClusterResult, descriptions: Sequence[Sequence[str]], cfg: ProfileConfig,
                  method: str = "k-means") -> dict[str, dict]:
    """For each grouping: profiles, distance map, similarity map and dendrogram, keyed by its columns."""
    out = {}
    k = len(result.centroids)
    similarity = profiles.bin_similarity(result.centroids, cfg.p) if cfg.metric == "quadratic_chi" else None
    for by in descriptions:
        rows = grouping.with_group_name(result.cells, by)
        groups = grouping.group_dimension(result.cells, by)
        prof = cut_lineage(profiles.cluster_profiles(rows, "vec", result.centroids, cfg.exp_factor, cfg.p, groups))
        if method == "mahalanobis":
            heat = validation.mahalanobis_group_map(rows, "group_name", "vec", len(result.scaling.features), groups=groups)
        elif cfg.metric == profiles.EDF_METRIC:
            weights = cut_lineage(edf.agreement_weights(rows, "group_name", "vec"))
            heat = profiles.mirrored(edf.group_distances(rows, [], "group_name", "vec", weights), prof.select(F.col("group_name").alias("name")))
        else:
            heat = profiles.distance_map(prof, cfg.metric, cfg.threshold, similarity, cfg.normalization, k, materialise=False)
        heat = cut_lineage(heat)
        entry = {"profiles": prof, "distances": heat}
        if method != "mahalanobis" and (cfg.metric == "summed_minmax" or cfg.metric in profiles.NORMALISED_METRICS):
            entry["similarities"] = profiles.similarity_map(heat, cfg.metric)
        entry["dendrogram"] = linkage.group_dendrogram(heat, cfg.linkage)
        out[",".join(by)] = entry
    return out
