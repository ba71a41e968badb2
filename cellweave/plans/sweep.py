"""Parameter grids and sweeps over clustering, profiling and validation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.config import ClusterConfig, SweepConfig
from cellweave.operators import normalize, profiles, summaries
from cellweave.plans import multi
from cellweave.plans.stages import run_clustering
from cellweave.session import cut_lineage, forget

GRID_KEYS = ("method", "param1", "param2", "param3", "param4", "exp_factor", "profile_metric")


def list_items(text: Column) -> Column:
    """Items of a list parameter separated by blanks, ',' or ';'."""
    return F.filter(F.split(text, r"[\s,;]+"), lambda x: x != "")


def typed_items(text: Column) -> Column:
    """Each item as int before float before string."""
    return F.transform(list_items(text), lambda x: F.struct(
        x.try_cast("bigint").alias("as_int"), x.try_cast("double").alias("as_float"), x.alias("as_string")))


def parameter_grid(spark: SparkSession, cfg: SweepConfig) -> DataFrame:
    """One row per combination of all list parameters, exploded list by list."""
    lists = {
        "method": cfg.methods, "param1": cfg.param1, "param2": cfg.param2, "param3": cfg.param3, "param4": cfg.param4,
        "exp_factor": cfg.exp_factors, "profile_metric": cfg.metrics}
    kinds = {"method": "string", "profile_metric": "string"}
    row = spark.createDataFrame(
        [tuple([list(v) if n in kinds else [float(x) for x in v] for n, v in lists.items()])],
        ", ".join(f"{n} array<{kinds.get(n, 'double')}>" for n in lists))
    for n in lists:
        row = row.withColumn(n, F.explode(n))
    return row


def grid_groups(grid: DataFrame, free: str) -> DataFrame:
    """Parameter sets equal in everything but one key."""
    keys = [c for c in grid.columns if c != free]
    return grid.groupBy(*keys).agg(F.sort_array(F.collect_list(free)).alias(f"{free}_values"))


def phenotype_cells(cells: DataFrame, controls: Sequence[str], group: str = "treatment") -> DataFrame:
    """``cells`` with the valid cells of the groups more penetrant than all controls together in the place of the non-control ones.

    Where no group is, the non-control cells stay.
    """
    kept = cut_lineage(summaries.penetrance_filter(cells, controls).select(group).distinct())
    if kept.isEmpty():
        return cells
    marked = kept.select(F.col(group).alias("_group"), F.lit(True).alias("_phenotype"))
    joined = cells.join(marked, cells[group].eqNullSafe(marked["_group"]), "left")
    return joined.withColumn("is_non_control", F.col("is_valid") & F.coalesce("_phenotype", F.lit(False))).drop("_group", "_phenotype")


def run_sweep(cells: DataFrame, features: Sequence[str], controls: Sequence[str], cfg: SweepConfig, seed_key: str,
              group: str = "treatment", replicate: str = "replicate", given: dict[str, np.ndarray] | None = None,
              id_col: str = "object_id") -> DataFrame:
    """One row per parameter set: n_clusters, quality, random_quality, replicate_quality and control_distance of its map.

    param1 is the number of clusters, param2 the number to merge down to (if positive), param3 the exponent of the
    distance, param4 the least size of a cluster. Clusters are fitted on the cells of groups that show a phenotype
    (``cfg.penetrance_filter``), profiles are those of the non-control cells. All Lloyd-type methods share their rounds, random
    centroids their passes; other methods are fitted once per clustering. ``given`` names methods whose centroids (on scaled features) are there.
    """
    given = given or {}
    spark = cells.sparkSession
    # every pass reads the valid cells only: the quality control runs once, and nothing else of it is kept
    names = dict.fromkeys((id_col, "treatment", group, replicate, seed_key, "seed_key", "is_valid", "is_non_control", *features))
    cells = cut_lineage(cells.filter("is_valid").select(*[c for c in names if c in cells.columns]))
    reference = cells.filter(F.col("is_valid") & F.col("treatment").isin(list(controls)))
    chosen = cells.filter("is_valid AND is_non_control")
    points, scaling = normalize.normalise(chosen, reference, features)
    fitting = phenotype_cells(cells, controls, group) if cfg.penetrance_filter else cells
    grid = [(i, g) for i, g in enumerate(parameter_grid(spark, cfg).collect())]  # parameter sets, as many as the lists give
    specs = {i: multi.Spec(g["method"], int(g["param1"]), float(g["param3"]), int(g["param4"]), int(g["param2"])) for i, g in grid}
    start = fitting.filter("is_valid AND is_non_control").withColumn("vec", scaling.vector())
    start = start.select(id_col, "vec").persist(StorageLevel.MEMORY_AND_DISK)
    fitted = multi.fit_many(start, "vec", [s for s in specs.values() if s.method in multi.FITTED and s.method not in given], id_col=id_col)
    for s in dict.fromkeys(specs.values()):
        if s.method in given:
            fitted[s] = np.asarray(given[s.method], dtype=float)
        elif s not in fitted:
            fitted[s] = run_clustering(fitting, features, controls, ClusterConfig(
                method=s.method, k=s.k, p=s.p, discard_size=s.discard, dissolve_size=0, target=s.target if s.target > 0 else None)).centroids
    start.unpersist()
    sets: dict[tuple, int] = {}
    metrics: dict[int, list[str]] = {}
    for i, g in grid:
        at = sets.setdefault((specs[i], float(g["exp_factor"])), len(sets))
        metrics.setdefault(at, [])
        if g["profile_metric"] not in metrics[at]:
            metrics[at].append(g["profile_metric"])
    models = [multi.ModelSet(fitted[s], s.p, e, tuple(metrics[at])) for (s, e), at in sets.items()]
    members = cut_lineage(multi.member_codes(points, group, replicate, controls, cfg.splits, seed_key).select("vec", "codes"))
    found = cut_lineage(multi.profile_many(members, "vec", models))
    distances = multi.distance_many(found, models)
    edf_sets = [at for at, m in metrics.items() if profiles.EDF_METRIC in m]
    if edf_sets:
        shared = multi.edf_many(members, "vec").select(
            F.explode(F.array(*[F.lit(at) for at in edf_sets])).alias("set"), F.lit(profiles.EDF_METRIC).alias("metric"), "*")
        distances = distances.unionByName(shared)
    scores = multi.qualities(distances, found)
    keys = spark.createDataFrame(
        [(*[g[n] for n in GRID_KEYS], len(fitted[specs[i]]), sets[specs[i], float(g["exp_factor"])]) for i, g in grid],
        "method string, param1 double, param2 double, param3 double, param4 double, exp_factor double, profile_metric string, n_clusters int, set int")
    out = cut_lineage(keys.join(scores.withColumnRenamed("metric", "profile_metric"), ["set", "profile_metric"]).select(
        *GRID_KEYS, "n_clusters", "quality", "random_quality", "replicate_quality", "control_distance"))
    for step in (cells, members, found):
        forget(step)
    return out
