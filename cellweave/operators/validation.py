"""Validation of distance maps: splits, controls, duplicates and map statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.config import SplitConfig
from cellweave.functions.scalars import above, ieee_divide, in_fraction, portable_hash
from cellweave.operators import edf
from cellweave.operators.blocks import pair_rows
from cellweave.operators.moments import grouped_moments, mean_forms, own_group_forms, with_group_inverse
from cellweave.operators.order_stats import distributed_rank, order_statistics, quantile
from cellweave.operators.profiles import EDF_METRIC, cluster_profiles, distance_map
from cellweave.session import cut_lineage


def random_split_rows(cells: DataFrame, splits: int, fraction: float, seed_key: str, seed: int = 1) -> DataFrame:
    """Membership rows (…, split) of seeded random parts; a cell may be in several or none. Map-only."""
    hits = [F.when(in_fraction(seed_key, seed + i, fraction), F.lit(i)) for i in range(splits)]
    return cells.withColumn("split", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))


def exact_split(cells: DataFrame, fraction: float, seed_key: str, id_col: str, seed: int = 1) -> DataFrame:
    """Exactly round(f·n) rows in hash order, decided by one order statistic and ties by id."""
    hashed = cells.withColumn("_h", portable_hash(seed_key, seed).cast("double"))
    n = hashed.count()
    keep = int(round(fraction * n))
    if keep <= 0:
        return cells.limit(0)
    cut = order_statistics(hashed, [], "_h", fraction, {"cut": lambda _: F.lit(keep - 1)}).first()["cut"]
    below = hashed.filter(F.col("_h") < F.lit(cut))
    ties = distributed_rank(hashed.filter(F.col("_h") == F.lit(cut)), [id_col])
    rest = keep - below.count()
    return below.select(*cells.columns).union(ties.filter(F.col("position") <= rest).select(*cells.columns))


def eligible_groups(cells: DataFrame, group: str, penetrance_threshold: float = 0.0) -> DataFrame:
    """Groups with at least two non-control cells and enough penetrance. One aggregate over the cells."""
    counts = cells.groupBy(group).agg(
        F.sum(F.col("is_non_control").cast("bigint")).alias("n_non_control"),
        F.sum(F.col("is_valid").cast("bigint")).alias("n_valid"))
    penetrance = ieee_divide(F.col("n_non_control").cast("double"), F.col("n_valid").cast("double"))
    return counts.withColumn("penetrance", penetrance).filter(
        (F.col("n_non_control") >= 2) & ~(F.col("penetrance") < penetrance_threshold))


def part_distances(members: DataFrame, group: str, part: str, vec: str, centroids: np.ndarray, metric: str,
                   exp_factor: float = -1.0, p: float = 2, similarity: np.ndarray | None = None,
                   m: float = 0.5) -> DataFrame:
    """Mean off-diagonal profile distance between the non-empty parts of each group: (group, n_parts, distance).

    Profiles are one row per (group, part); parts pair only inside their group. With the metric ``kolmo_smirnov`` the
    values of the cells are compared, each feature weighted by the agreement of the groups on it.
    """
    if metric == EDF_METRIC:
        rows = members.select(F.col(group).cast("string").alias("_group"), F.col(part).cast("string").alias("_part"), F.col(vec).alias("_vec"))
        weights = cut_lineage(edf.agreement_weights(rows, "_group", "_vec")) if rows.select("_group").distinct().count() > 1 else None
        off = edf.group_distances(rows, ["_group"], "_part", "_vec", weights).groupBy("_group").agg(F.avg("distance").alias("distance"))
        parts = rows.groupBy("_group").agg(F.count_distinct("_part").alias("n_parts")).filter("n_parts >= 2")
        return parts.join(off, "_group").select(F.col("_group").alias(group), "n_parts", "distance")
    keyed = members.withColumn("group_name", F.concat_ws("\u0001", F.col(group).cast("string"), F.col(part).cast("string")))
    profiles = cluster_profiles(keyed, vec, centroids, exp_factor, p)
    names = F.split("group_name", "\u0001")
    profiles = cut_lineage(profiles.select(names[0].alias("_group"), names[1].alias("group_name"), "profile"))
    heat = distance_map(profiles, metric, similarity=similarity, m=m, k=len(centroids), within=["_group"],
                        materialise=False)
    off = heat.filter(F.col("row_group") != F.col("col_group")).groupBy("_group").agg(F.avg("distance").alias("distance"))
    parts = profiles.groupBy("_group").agg(F.count("*").alias("n_parts")).filter("n_parts >= 2")
    return parts.join(off, "_group").select(F.col("_group").alias(group), "n_parts", "distance")


def random_split_distances(cells: DataFrame, group: str, vec: str, centroids: np.ndarray, metric: str, seed_key: str,
                           cfg: SplitConfig, **kw) -> DataFrame:
    keep = eligible_groups(cells, group, cfg.penetrance_threshold).select(group)
    chosen = cells.filter("is_non_control").join(keep, group, "left_semi")
    rows = random_split_rows(chosen, cfg.random_splits, cfg.random_fraction, seed_key, cfg.seed)
    return part_distances(rows, group, "split", vec, centroids, metric, **kw)


def replicate_split_distances(cells: DataFrame, group: str, vec: str, centroids: np.ndarray, metric: str,
                              cfg: SplitConfig, replicate: str = "replicate", **kw) -> DataFrame:
    keep = eligible_groups(cells, group, cfg.penetrance_threshold).select(group)
    chosen = cells.filter("is_non_control").join(keep, group, "left_semi")
    return part_distances(chosen, group, replicate, vec, centroids, metric, **kw)


def control_comparison(cells: DataFrame, controls: Sequence[str], vec: str, centroids: np.ndarray, metric: str,
                       **kw) -> DataFrame:
    """Mean off-diagonal distance between the control treatment × replicate groups (one row)."""
    chosen = cells.filter(F.col("treatment").isin(list(controls))).withColumns({
        "_all": F.lit("controls"), "_part": F.concat_ws("_", "treatment", "replicate")})
    return part_distances(chosen, "_all", "_part", vec, centroids, metric, **kw).select("n_parts", "distance")


def treatment_map(heatmap: DataFrame, random_dist: DataFrame, replicate_dist: DataFrame, group: str,
                  replicate_threshold: float) -> DataFrame:
    """Heatmap with the random-split distances on the diagonal (when every group has one) and a flag
    for rows or columns whose replicate distance is above the threshold."""
    heatmap, random_dist = cut_lineage(heatmap), cut_lineage(random_dist)
    groups = heatmap.select("row_group").distinct()
    have = groups.join(random_dist.select(F.col(group).alias("row_group")), "row_group", "left_semi").count()
    complete = have == groups.count()
    diag = random_dist.select(F.col(group).alias("row_group"), F.col("distance").alias("_self"))
    flagged = replicate_dist.filter(above(F.col("distance"), F.lit(float(replicate_threshold)))).select(
        F.col(group).alias("_g"))
    out = heatmap.join(diag, "row_group", "left")
    on_diag = (F.col("row_group") == F.col("col_group")) & F.lit(complete)
    out = out.withColumn("distance", F.when(on_diag, F.col("_self")).otherwise(F.col("distance"))).drop("_self")
    for side in ("row_group", "col_group"):
        bad = flagged.select(F.col("_g").alias(side), F.lit(True).alias(f"_bad_{side}"))
        out = out.join(bad, side, "left")
    flag = F.coalesce("_bad_row_group", F.lit(False)) | F.coalesce("_bad_col_group", F.lit(False))
    return out.select("row_group", "col_group", "distance", flag.alias("is_flagged"))


def combine_maps(runs: DataFrame) -> DataFrame:
    """Element-wise mean over runs of long heatmaps."""
    return runs.groupBy("row_group", "col_group").agg(F.avg("distance").alias("distance"))


def diagonal_statistics(runs: DataFrame, keys: Sequence[str] = ("kind", "label")) -> DataFrame:
    """Mean and deviation of diagonal entries over runs."""
    return runs.groupBy(*keys).agg(F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("std_value"))


def diagonal_by_clusters(runs: DataFrame) -> DataFrame:
    """Per kind and number of clusters: every label, and '*' for all labels together."""
    rolled = runs.groupingSets([["kind", "param1", "label"], ["kind", "param1"]], "kind", "param1", "label").agg(
        F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("std_value"), F.grouping("label").alias("_all"))
    return rolled.select("kind", "param1", F.when(F.col("_all") == 1, F.lit("*")).otherwise(F.col("label")).alias("label"),
                         "mean_value", "std_value")


def best_quality(curve: DataFrame, metric: str = "metric", x: str = "param1", y: str = "quality") -> DataFrame:
    """Best point of each metric's curve (largest quality, ties to the smaller parameter)."""
    return curve.groupBy(metric).agg(F.max_by(F.struct(x, y), F.struct(F.col(y), -F.col(x))).alias("b")).select(
        metric, F.col(f"b.{x}").alias(x), F.col(f"b.{y}").alias(y))


# ---- duplicated treatments ----------------------------------------------------


def duplicate_at_random(cells: DataFrame, seed_key: str, id_col: str = "object_id", seed: int = 3) -> DataFrame:
    """Each treatment becomes ``name`` (larger half) and ``name*`` (n//2 cells) in hash order.

    The half is a rank cut: one order statistic per treatment plus ranked ties,
    so a treatment may be of any size. Cells without a treatment stay as they are.
    """
    nameless = cells.filter(F.col("treatment").isNull())
    hashed = cells.filter(F.col("treatment").isNotNull()).withColumn("_h", portable_hash(seed_key, seed).cast("double"))
    cut = order_statistics(hashed, ["treatment"], "_h", 0.5, {"cut": lambda n: n - F.floor(n / 2) - 1})
    joined = hashed.join(cut.select("treatment", "cut", F.col("n").alias("_n")), "treatment")
    below = joined.filter("_h < cut").groupBy("treatment").agg(F.count("*").alias("_below"))
    tied = F.col("_h").eqNullSafe(F.col("cut"))
    # Only the rows at the cut are ranked; all others are decided where they are.
    ties = distributed_rank(joined.filter(tied), [id_col], ["treatment"]).join(below, "treatment", "left").withColumn(
        "_keep", F.col("position") + F.coalesce("_below", F.lit(0)) <= F.col("_n") - F.floor(F.col("_n") / 2))
    rest = joined.filter(~tied).withColumn("_keep", F.coalesce(F.col("_h") < F.col("cut"), F.lit(False)))
    name = F.when(F.col("_keep"), F.col("treatment")).otherwise(F.concat("treatment", F.lit("*"))).alias("treatment")
    out = [*[c for c in cells.columns if c != "treatment"], name]
    return rest.select(*out).unionByName(ties.select(*out)).unionByName(nameless.select(*[c for c in cells.columns if c != "treatment"], "treatment"))


def replicate_directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def duplicate_by_replicate(images: DataFrame, directory: str) -> DataFrame:
    """First half of the sorted replicate directories of a treatment keeps the name, the rest gets ``name*``."""
    names = images.select("treatment", directory).distinct()
    w = Window.partitionBy("treatment")
    ranked = names.withColumns({
        "_rank": F.dense_rank().over(w.orderBy(directory)), "_count": F.count("*").over(w)})
    half = ranked.withColumn("_first", F.col("_rank") <= F.ceil(F.col("_count") / 2)).select(
        "treatment", directory, "_first")
    return images.join(half, ["treatment", directory]).withColumn(
        "treatment", F.when(F.col("_first"), F.col("treatment")).otherwise(F.concat("treatment", F.lit("*")))).drop("_first")


# ---- statistics of maps over split pairs --------------------------------------


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\*$", "")


def split_pair_statistics(heatmap: DataFrame) -> DataFrame:
    """Per original treatment: self match of its two halves and its distances to all other groups.

    Columns where either half is NaN are left out of the comparison with others.
    """
    h = cut_lineage(heatmap).withColumns({"row_base": base_name(F.col("row_group")), "col_base": base_name(F.col("col_group"))})
    own = h.filter((F.col("row_base") == F.col("col_base")) & (F.col("row_group") < F.col("col_group"))).select(
        F.col("row_base").alias("label"), F.col("distance").alias("self_match"))
    others = h.filter(F.col("row_base") != F.col("col_base"))
    bad = others.filter(F.isnan("distance")).select("row_base", "col_group").distinct()
    good = others.join(bad, ["row_base", "col_group"], "left_anti")
    stats = good.groupBy(F.col("row_base").alias("label")).agg(
        F.avg("distance").alias("mean_others"), F.min("distance").alias("min_others"),
        F.max("distance").alias("max_others"))
    med = quantile(good.select(F.col("row_base").alias("label"), "distance"), ["label"], "distance", 0.5, "median_others")
    return own.join(stats, "label", "left").join(med.drop("n"), "label", "left").select(
        "label", "self_match", "median_others", "mean_others", "min_others", "max_others",
        (F.col("min_others") - F.col("self_match")).alias("min_minus_self"),
        (F.col("self_match") - F.col("max_others")).alias("self_minus_max"))


def modified_similarity(heatmap: DataFrame) -> DataFrame:
    """2×2 block mean per pair of originals times smaller over larger self match."""
    h = cut_lineage(heatmap).withColumns({"row_base": base_name(F.col("row_group")), "col_base": base_name(F.col("col_group"))})
    own = h.filter((F.col("row_base") == F.col("col_base")) & (F.col("row_group") < F.col("col_group"))).select(
        F.col("row_base").alias("base"), F.col("distance").alias("self_match"))
    # a group is as far from itself as from its other half
    filled = h.join(own.withColumnRenamed("base", "row_base"), "row_base").withColumn(
        "distance", F.when(F.col("row_group") == F.col("col_group"), F.col("self_match")).otherwise(F.col("distance")))
    blocks = filled.groupBy("row_base", "col_base").agg(
        F.avg("distance").alias("block_mean"), F.first("self_match").alias("_row_self"))
    other = own.select(F.col("base").alias("col_base"), F.col("self_match").alias("_col_self"))
    low, high = F.least("_row_self", "_col_self"), F.greatest("_row_self", "_col_self")
    ratio = F.when(high == 0, F.lit(1.0)).otherwise(low / F.when(high != 0, high))
    return blocks.join(other, "col_base").select("row_base", "col_base", (F.col("block_mean") * ratio).alias("similarity"))


def heatmap_threshold(heatmap: DataFrame) -> DataFrame:
    """Twice the largest distance between the two halves of a treatment."""
    pair = (base_name(F.col("row_group")) == base_name(F.col("col_group"))) & (F.col("row_group") < F.col("col_group"))
    return heatmap.filter(pair).agg((F.lit(2.0) * F.max("distance")).alias("threshold"))


def treatment_comparison(heatmap: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Per group: self distance, mean to its neighbours (row_group, col_group pairs) and mean to the others."""
    near = neighbours.select("row_group", "col_group", F.lit(True).alias("_near"))
    joined = heatmap.join(near, ["row_group", "col_group"], "left")
    is_self = F.col("row_group") == F.col("col_group")
    close = F.coalesce("_near", F.lit(False))
    return joined.groupBy("row_group").agg(
        F.max(F.when(is_self, F.col("distance"))).alias("self_distance"),
        F.avg(F.when(~is_self & close, F.col("distance"))).alias("neighbour_mean"),
        F.avg(F.when(~is_self & ~close, F.col("distance"))).alias("other_mean"))


def mahalanobis_group_map(members: DataFrame, group: str, vec: str, p: int, fraction: float = 0.8,
                          id_col: str = "object_id", groups: DataFrame | None = None) -> DataFrame:
    """Mean squared Mahalanobis distance of group j to the trimmed reference of group i (asymmetric).

    Group means, inverses and trim cuts are one row per group; the mean quadratic form follows from group moments, so
    cells are never paired or joined with a matrix. Groups with a singular covariance give NULL.
    """
    rows = members.select(F.col(group).cast("string").alias("g"), F.col(id_col).alias("_id"), F.col(vec).alias("_v"))
    full = cut_lineage(with_group_inverse(grouped_moments(rows, ["g"], "_v", p), p))

    trimmed = full
    if fraction < 1.0:
        own = cut_lineage(own_group_forms(rows, full, "_v", p, "_d"))
        keep = lambda n: F.least(F.bround(n * F.lit(fraction)).cast("bigint") + 1, n)
        cut = order_statistics(own, ["g"], "_d", fraction, {"cut": lambda n: keep(n) - 1}).select("g", "cut", "n")
        joined = own.join(cut, "g")
        below = joined.filter("_d < cut").groupBy("g").agg(F.count("*").alias("_below"))
        ties = distributed_rank(joined.filter("_d = cut").select("g", "_id"), ["_id"], ["g"]).select(
            "g", "_id", F.col("position").alias("_tie"))
        chosen = joined.join(below, "g", "left").join(ties, ["g", "_id"], "left").filter(
            (F.col("_d") < F.col("cut"))
            | (F.col("_tie") + F.coalesce("_below", F.lit(0)) <= keep(F.col("n"))))
        trimmed = cut_lineage(with_group_inverse(grouped_moments(chosen, ["g"], "_v", p), p))
    out = mean_forms(trimmed, full, p)
    if groups is None:
        return out
    names = groups.select(F.col("group_name").cast("string").alias("row_group"))
    every = pair_rows(names, names.withColumnRenamed("row_group", "col_group"), "row_group", "col_group")
    return every.join(out, ["row_group", "col_group"], "left").select(
        "row_group", "col_group", F.coalesce("distance", F.lit(float("nan"))).alias("distance"))
