"""Cluster profiles of groups and the distance maps between them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.scalars import ieee_divide, is_finite
from cellweave.functions.vectors import array_sum, distance_matrix, linear_map, nearest, normalised, quadratic_form
from cellweave.operators.assign import with_distances
from cellweave.operators.blocks import pair_rows
from cellweave.session import cut_lineage

METRICS = ("summed_minmax", "l2_norm", "l1_norm", "chi1_norm", "chi2_norm", "quadratic_chi", "summed_difference")
#: Compares the values of the cells themselves, not their profiles: ``edf.group_distances``.
EDF_METRIC = "kolmo_smirnov"
NORMALISED_METRICS = ("l2_norm", "l1_norm", "chi1_norm", "chi2_norm", "quadratic_chi")


def smallest_centroid_distance(centroids: np.ndarray, p: float = 2) -> float:
    d = distance_matrix(centroids, centroids, p)
    return float(d[~np.eye(len(d), dtype=bool)].min())


def soft_membership(dist: Column, delta: float) -> Column:
    return normalised(F.transform(dist, lambda d: F.exp(-d / F.lit(delta))))


def _with_empty_groups(profiles: DataFrame, groups: DataFrame | None, k: int, filler: float) -> DataFrame:
    if groups is None:
        return profiles
    blank = F.array_repeat(F.lit(filler), k)
    return groups.select("group_name").join(profiles, "group_name", "left").select(
        "group_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.coalesce("profile", blank).alias("profile"))


def soft_profiles(members: DataFrame, vec: str, centroids: np.ndarray, p: float = 2,
                  groups: DataFrame | None = None) -> DataFrame:
    """Mean over the cells of exp(−d/δ) scaled to sum 1; empty groups are NaN.

    ``members`` has one row per (group_name, cell). Per-bin sums combine on the
    map side, so a group may hold any share of the rows.
    """
    k = len(centroids)
    delta = smallest_centroid_distance(centroids, p)
    rows = with_distances(members, vec, centroids, p).withColumn("_m", soft_membership(F.col("dist"), delta))
    out = rows.groupBy("group_name").agg(
        F.count("*").alias("n"), F.array(*[F.avg(F.col("_m")[i]) for i in range(k)]).alias("profile"))
    return _with_empty_groups(out, groups, k, float("nan"))


def smoothed_profiles(members: DataFrame, vec: str, centroids: np.ndarray, exp_factor: float, p: float = 2,
                      groups: DataFrame | None = None) -> DataFrame:
    """Sum over the cells of 1/d similarities, sharpened by ``exp_factor``; empty groups are 0.

    A cell on a centroid counts for that centroid alone. With a positive factor
    similarities are first divided by the largest one of the whole group.
    """
    k = len(centroids)
    rows = with_distances(members, vec, centroids, p)
    on_centroid = F.exists("dist", lambda d: d == 0)
    sim = F.when(on_centroid, F.transform("dist", lambda d: F.when(d == 0, 1.0).otherwise(0.0))).otherwise(
        F.transform("dist", lambda d: F.lit(1.0) / d))
    rows = rows.withColumn("_s", sim)
    if exp_factor > 0:
        top = rows.groupBy("group_name").agg(F.max(F.array_max("_s")).alias("_top"))
        scale = F.lit(float(np.exp(exp_factor) - 1.0))
        rows = rows.join(top, "group_name").withColumn("_s", F.transform(
            "_s", lambda s: (F.exp(F.lit(float(exp_factor)) * s / F.col("_top")) - 1.0) / scale))
    rows = rows.withColumn("_m", normalised(F.col("_s")))
    out = rows.groupBy("group_name").agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.col("_m")[i]) for i in range(k)]).alias("profile"))
    return _with_empty_groups(out, groups, k, 0.0)


def hard_profiles(members: DataFrame, vec: str, centroids: np.ndarray, p: float = 2,
                  groups: DataFrame | None = None) -> DataFrame:
    """Number of cells nearest to each centroid."""
    k = len(centroids)
    rows = with_distances(members, vec, centroids, p).withColumn("_c", nearest(F.col("dist")))
    out = rows.groupBy("group_name").agg(
        F.count("*").alias("n"),
        F.array(*[F.sum((F.col("_c") == i).cast("double")) for i in range(k)]).alias("profile"))
    return _with_empty_groups(out, groups, k, 0.0)


def cluster_profiles(members: DataFrame, vec: str, centroids: np.ndarray, exp_factor: float = -1.0, p: float = 2,
                     groups: DataFrame | None = None) -> DataFrame:
    if exp_factor < 0:
        return soft_profiles(members, vec, centroids, p, groups)
    return smoothed_profiles(members, vec, centroids, exp_factor, p, groups)


def normalised_profile(profile: Column, threshold: float = 0.0) -> Column:
    """Profile scaled to sum 1; bins below threshold·max are cleared and the rest scaled again."""
    if threshold <= 0:
        return normalised(profile)
    top = F.array_max(profile)
    return normalised(F.transform(profile, lambda x: F.when(x < top * F.lit(threshold), 0.0).otherwise(x)))


def normalise_profiles(profiles: DataFrame, threshold: float = 0.0) -> DataFrame:
    return profiles.withColumn("profile", normalised_profile(F.col("profile"), threshold))


def bin_similarity(centroids: np.ndarray, p: float = 2, batch: bool = False) -> np.ndarray:
    """k×k similarity of the bins: exp(−d/δ), or exp(−d) in the batch variant."""
    d = distance_matrix(centroids, centroids, p)
    np.fill_diagonal(d, 0.0)
    return np.exp(-d if batch else -d / smallest_centroid_distance(centroids, p))


def _ratio_sum(numerator) -> Column:
    """Σ numerator(p−q)/(p+q) with 0/0 = 0."""
    term = F.zip_with("_p", "_q", lambda x, y: F.when((x == 0) & (y == 0), F.lit(0.0)).otherwise(
        ieee_divide(numerator(x - y), x + y)))
    return array_sum(term)


def profile_distance(pairs: DataFrame, metric: str, similarity: np.ndarray | None = None, m: float = 0.5,
                     k: int | None = None) -> DataFrame:
    """Adds ``distance`` between the arrays ``_p`` and ``_q`` of each row."""
    if metric == "summed_minmax":
        low = array_sum(F.zip_with("_p", "_q", lambda x, y: F.least(x, y) * F.least(x, y)))
        high = array_sum(F.zip_with("_p", "_q", lambda x, y: F.greatest(x, y) * F.greatest(x, y)))
        return pairs.withColumn("distance", F.lit(1.0) - ieee_divide(low, high))
    if metric == "l2_norm":
        return pairs.withColumn("distance", F.sqrt(array_sum(
            F.zip_with("_p", "_q", lambda x, y: (x - y) * (x - y)))))
    if metric in ("l1_norm", "summed_difference"):
        return pairs.withColumn("distance", array_sum(F.zip_with("_p", "_q", lambda x, y: F.abs(x - y))))
    if metric == "chi1_norm":
        return pairs.withColumn("distance", _ratio_sum(F.abs))
    if metric == "chi2_norm":
        return pairs.withColumn("distance", _ratio_sum(lambda d: d * d))
    if metric == "quadratic_chi":
        a = np.eye(k) if similarity is None else np.asarray(similarity, dtype=float)
        # profiles and similarities are not negative, so ((p+q)·A)^m = (p+q)^m · A^m
        out = pairs.withColumn("_w", F.zip_with("_p", "_q", lambda x, y: F.pow(x + y, F.lit(float(m)))))
        out = out.withColumn("_d", linear_map(F.col("_w"), a ** m))
        diff = F.zip_with("_p", "_q", lambda x, y: x - y)
        out = out.withColumn("_z", F.zip_with(diff, "_d", lambda n, d: F.when(d == 0, F.lit(0.0)).otherwise(
            ieee_divide(n, d))))
        return out.withColumn("distance", quadratic_form(F.col("_z"), np.zeros(len(a)), a)).drop("_w", "_d", "_z")
    raise ValueError(f"no such profile metric: {metric}")


def distance_map(profiles: DataFrame, metric: str, threshold: float = 0.0, similarity: np.ndarray | None = None,
                 m: float = 0.5, k: int | None = None, within: Sequence[str] = (),
                 materialise: bool = True) -> DataFrame:
    """Long heatmap (within…, row_group, col_group, distance): each pair once, mirrored, zero diagonal.

    ``within`` restricts pairs to equal keys, e.g. the parts of one group. The
    profiles (one row per group) are written once, so the cells are read once.
    """
    if materialise:
        profiles = cut_lineage(profiles)
    norm = normalise_profiles(profiles, threshold)
    a = norm.select(*within, F.col("group_name").alias("row_group"), F.col("profile").alias("_p"))
    b = norm.select(*within, F.col("group_name").alias("col_group"), F.col("profile").alias("_q"))
    pairs = pair_rows(a, b, "row_group", "col_group", on=within, condition=F.col("row_group") > F.col("col_group"))
    half = profile_distance(pairs, metric, similarity, m, k).select(*within, "row_group", "col_group", "distance")
    return mirrored(half, profiles.select(*within, F.col("group_name").alias("name")), within)


def mirrored(half: DataFrame, names: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Long heatmap of (within…, row_group, col_group, distance) with each pair once: both directions and a zero per name."""
    both = half.select(
        *within, "distance",
        F.explode(F.array(F.struct(F.col("row_group").alias("a"), F.col("col_group").alias("b")),
                          F.struct(F.col("col_group").alias("a"), F.col("row_group").alias("b")))).alias("e"))
    off = both.select(*within, F.col("e.a").alias("row_group"), F.col("e.b").alias("col_group"), "distance")
    return off.union(names.select(*within, F.col("name").alias("row_group"), F.col("name").alias("col_group"), F.lit(0.0).alias("distance")))


def similarity_map(heatmap: DataFrame, metric: str) -> DataFrame:
    """1 − d, for unbounded metrics relative to the largest finite distance."""
    if metric == "summed_minmax":
        return heatmap.withColumn("similarity", F.lit(1.0) - F.col("distance"))
    if metric not in NORMALISED_METRICS:
        raise ValueError(f"no similarity map for profile metric: {metric}")
    top = heatmap.filter(is_finite(F.col("distance"))).agg(F.max("distance")).first()[0]
    if top is None:
        return heatmap.withColumn("similarity", F.col("distance"))
    scale = float(top) if top > 0 else 1.0
    return heatmap.withColumn("similarity", F.lit(1.0) - F.col("distance") / F.lit(scale))


def map_quality(heatmap: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean off-diagonal minus mean diagonal entry."""
    diagonal = F.col("row_group") == F.col("col_group")
    return heatmap.groupBy(*keys).agg(
        (F.avg(F.when(~diagonal, F.col("distance"))) - F.avg(F.when(diagonal, F.col("distance")))).alias("quality"))


def profile_overlap(profiles: DataFrame, first: str, second: str) -> DataFrame:
    """Bin-wise minimum of two normalised profiles and what each has beyond it."""
    norm = normalise_profiles(profiles)
    a = norm.filter(F.col("group_name") == F.lit(first)).select(F.posexplode("profile").alias("cluster", "p"))
    b = norm.filter(F.col("group_name") == F.lit(second)).select(F.posexplode("profile").alias("cluster", "q"))
    low = F.least("p", "q")
    return a.join(b, "cluster").select(
        "cluster", low.alias("overlap"), (F.col("p") - low).alias("first_rest"), (F.col("q") - low).alias("second_rest"))


def explode_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.select("group_name", "n", F.posexplode("profile").alias("cluster", "value"))
