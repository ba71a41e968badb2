"""Many models at once against one after another, and the sweep over them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.config import ClusterConfig, ProfileConfig, SplitConfig, SweepConfig
from cellweave.functions.vectors import nearest_rows
from cellweave.operators import edf, kmeans, profiles, validation
from cellweave.plans import multi, stages, sweep

RNG = np.random.default_rng(11)
X = np.concatenate([RNG.normal(size=(90, 3)) + 6 * RNG.normal(size=3) for _ in range(5)] + [RNG.normal(size=(6, 3)) + 30])


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(i, 7919 * i + 5, "NABN"[i % 4], int(i // 3 % 2), True, bool(i % 5 != 0), *map(float, x)) for i, x in enumerate(X)]
    return spark.createDataFrame(
        rows, "object_id bigint, seed_key bigint, treatment string, replicate int, is_valid boolean, is_non_control boolean, f1 double, f2 double, f3 double").cache()


@pytest.fixture(scope="module")
def points(cells):
    return cells.select("object_id", "seed_key", "treatment", "replicate", "is_valid", "is_non_control", F.array("f1", "f2", "f3").alias("vec")).cache()


def test_fits_equal_single_fits(cells):
    specs = [multi.Spec(m, k, p, d, t) for m, k, p, d, t in (
        ("k-means", 4, 2.0, 0, -1), ("k-means", 7, 2.0, 10, -1), ("k-means", 7, 1.0, 10, 3), ("swap-k-means", 7, 2.0, 10, 4), ("lloyd", 6, 2.0, 10, -1))]
    kept = cells.filter("is_valid AND is_non_control")
    scaled = stages.run_clustering(cells, ["f1", "f2", "f3"], ["N"], ClusterConfig("lloyd", 2, discard_size=0, dissolve_size=0))
    found = multi.fit_many(kept.withColumn("vec", scaled.scaling.vector()), "vec", specs)
    for s in specs:
        alone = stages.run_clustering(cells, ["f1", "f2", "f3"], ["N"], ClusterConfig(
            s.method, s.k, s.p, s.discard, 0, target=s.target if s.target > 0 else None))
        assert found[s].shape == alone.centroids.shape and np.allclose(found[s], alone.centroids, atol=1e-9), s


def test_random_centroids_are_fitted_with_the_others(spark, cells):
    """Random specs once took a clustering run each; those that differ in what follows share their passes."""
    specs = [multi.Spec("random", k, 2.0, d, t) for k, d, t in ((5, 0, -1), (5, 3, -1), (8, 3, -1), (8, 3, 3), (8, 0, 2), (8, 10_000, -1))]
    odd = cells.limit(1).withColumns({"object_id": F.lit(-1).cast("bigint"), "f2": F.lit(None).cast("double")})
    every = cells.unionByName(odd.withColumns({"is_valid": F.lit(True), "is_non_control": F.lit(True)}))
    scaled = stages.run_clustering(every, ["f1", "f2", "f3"], ["N"], ClusterConfig("random", 2, discard_size=0, dissolve_size=0))
    start = every.filter("is_valid AND is_non_control").withColumn("vec", scaled.scaling.vector())
    found = {}
    assert jobs(spark, "random", lambda: found.update(multi.fit_many(start, "vec", specs))) <= 20
    spark.sparkContext.setJobGroup("rest", "rest")
    for s in specs:
        alone = stages.run_clustering(every, ["f1", "f2", "f3"], ["N"], ClusterConfig(
            s.method, s.k, s.p, s.discard, 0, target=s.target if s.target > 0 else None))
        assert found[s].shape == alone.centroids.shape and np.allclose(found[s], alone.centroids, atol=1e-9), s


def test_fits_on_the_same_centres_share_the_search(monkeypatch):
    c, before = X[[0, 100, 200]], X[[1, 101, 201]]
    fits = [kmeans.LloydFit(c, 2, 1e-4, t, None, True) for t in (None, 0, 1)] + [kmeans.LloydFit(c, 1.0)]
    fits[2].previous = before
    want = np.vstack([f.sums(X) for f in fits])
    searched = []
    monkeypatch.setattr(kmeans, "nearest_rows", lambda *a: searched.append(a) or nearest_rows(*a))
    assert np.array_equal(kmeans.joint_sums(X, fits), want)
    assert len(searched) == 3  # Euclidean, Manhattan, and those of the round before


def jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    work()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_rounds_do_not_cost_a_job_per_model(spark, points):
    one = jobs(spark, "one-model", lambda: multi.fit_many(points, "vec", [multi.Spec("lloyd", 8)]))
    many = jobs(spark, "many-models", lambda: multi.fit_many(points, "vec", [multi.Spec("lloyd", k) for k in (8, 2, 3, 4, 5, 6, 7)]))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert many <= one + 20 < 7 * one  # the longest fit of all sets the number of rounds


@pytest.mark.parametrize("factor", [-1.0, 0.0, 6.0])
def test_profiles_and_distances_equal_the_single_ones(points, factor):
    splits = SplitConfig(3, 0.5, 0.0)
    sets = [multi.ModelSet(X[[0, 100, 200]], 2.0, factor, profiles.METRICS), multi.ModelSet(X[[0, 95, 190, 280, 370]], 1.0, factor, ("l1_norm", "quadratic_chi"))]
    members = multi.member_codes(points, "treatment", "replicate", ["N"], splits, "seed_key")
    found = multi.profile_many(members, "vec", sets).cache()
    far = {(r["set"], r["metric"], r["kind"], r["outer"], r["row_group"], r["col_group"]): r["distance"] for r in multi.distance_many(found, sets).collect()}
    for i, s in enumerate(sets):
        single = profiles.cluster_profiles(points.withColumn("group_name", F.col("treatment")), "vec", s.centroids, factor, s.p)
        got = {r["inner"]: r["profile"] for r in found.filter(f"set = {i} and kind = 'g'").collect()}
        assert got.keys() == {"N", "A", "B"}
        for r in single.collect():
            assert np.allclose(got[r["group_name"]], r["profile"], rtol=1e-9)
        for metric in s.metrics:
            kw = {"similarity": profiles.bin_similarity(s.centroids, s.p, batch=True), "m": 1.0} if metric == "quadratic_chi" else {}
            for r in profiles.distance_map(single, metric, k=len(s.centroids), **kw).filter("row_group > col_group").collect():
                assert far[i, metric, "g", "", r["row_group"], r["col_group"]] == pytest.approx(r["distance"], rel=1e-8, abs=1e-12)
        kw = {"exp_factor": factor, "p": s.p}
        for kind, alone in (("r", validation.random_split_distances(points, "treatment", "vec", s.centroids, "l1_norm", "seed_key", splits, **kw)),
                            ("p", validation.replicate_split_distances(points, "treatment", "vec", s.centroids, "l1_norm", splits, **kw))):
            if kind == "r":
                continue  # the single form takes the non-control cells only, see below
            chosen = points.filter("is_non_control")
            members_ = multi.member_codes(chosen, "treatment", "replicate", ["N"], splits, "seed_key")
            own = multi.distance_many(multi.profile_many(members_, "vec", [s]), [s]).filter(f"kind = '{kind}' and metric = 'l1_norm'").groupBy("outer").agg(F.avg("distance").alias("d"))
            want = {r["treatment"]: r["distance"] for r in alone.collect()}
            assert {r["outer"]: pytest.approx(r["d"]) for r in own.collect()} == want


def ks(a, b):
    grid = np.concatenate([a, b])
    return np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)).max()


def test_kolmo_smirnov_is_a_metric_of_splits_drivers_and_sweep(spark, cells, points):
    samples = {}
    for r in points.collect():
        samples.setdefault(r["treatment"], []).append(r["vec"])
        samples.setdefault((r["treatment"], str(r["replicate"])), []).append(r["vec"])
    samples = {k: np.array(v) for k, v in samples.items()}
    names = ["A", "B", "N"]
    gaps = {(a, b): np.array([ks(samples[a][:, f], samples[b][:, f]) for f in range(3)]) for a in names for b in names if a < b}
    mean = np.mean(list(gaps.values()), axis=0)
    w = (mean.max() - mean) / np.sqrt(((mean.max() - mean) ** 2).sum())
    members = multi.member_codes(points, "treatment", "replicate", ["N"], SplitConfig(2, 0.5, 0.0), "seed_key")
    for r in multi.edf_many(members, "vec").filter("kind = 'g'").collect():
        assert r["distance"] == pytest.approx(np.sqrt(((w * gaps[r["col_group"], r["row_group"]]) ** 2).sum()))
    rep = validation.part_distances(points, "treatment", "replicate", "vec", X[:2], "kolmo_smirnov")
    for r in rep.collect():
        t = r["treatment"]
        gap = np.array([ks(samples[t, "0"][:, f], samples[t, "1"][:, f]) for f in range(3)])
        assert r["n_parts"] == 2 and r["distance"] == pytest.approx(np.sqrt(((w * gap) ** 2).sum()))
    result = stages.run_clustering(cells, ["f1", "f2", "f3"], ["N"], ClusterConfig("lloyd", 3, discard_size=0, dissolve_size=0))
    heat = stages.run_profiling(result, [["treatment"]], ProfileConfig(metric="kolmo_smirnov"))["treatment"]["distances"].collect()
    assert len(heat) == 9 and {r["distance"] for r in heat if r["row_group"] == r["col_group"]} == {0.0}


def test_sweep_rows(cells):
    cfg = SweepConfig(methods=("k-means", "random"), param1=(5, 8), param2=(-1, 3), param4=(2,), exp_factors=(-1.0, 5.0),
                      metrics=("l1_norm", "quadratic_chi", "kolmo_smirnov"), splits=SplitConfig(2, 0.5, 0.0))
    rows = sweep.run_sweep(cells, ["f1", "f2", "f3"], ["N"], cfg, "seed_key").collect()
    assert len(rows) == 48
    for r in rows:
        assert r["n_clusters"] <= (3 if r["param2"] == 3 else r["param1"])
        assert r["quality"] == pytest.approx(r["random_quality"]) and r["control_distance"] > 0 and r["replicate_quality"] is not None
    assert len({r["quality"] for r in rows if r["profile_metric"] == "kolmo_smirnov"}) == 1  # no model takes part
    assert len({(r["param2"], r["quality"]) for r in rows if (r["method"], r["param1"], r["exp_factor"], r["profile_metric"]) == ("k-means", 8, -1.0, "l1_norm")}) == 2


def test_only_phenotypes_are_clustered(spark):
    rows = [(t, True, i < n) for t, n in (("N", 3), ("A", 8), ("B", 2), (None, 9)) for i in range(10)]
    df = spark.createDataFrame(rows, "treatment string, is_valid boolean, is_non_control boolean")
    got = {r["treatment"]: r["n"] for r in sweep.phenotype_cells(df, ["N"]).filter("is_non_control").groupBy("treatment").agg(F.count("*").alias("n")).collect()}
    assert got == {"A": 10}
    calm = sweep.phenotype_cells(df.filter("treatment IN ('N', 'B')"), ["N"])
    assert calm.filter("is_non_control").count() == 5


@pytest.mark.parametrize("method", ["average", "complete", "weighted"])
def test_linkages_of_points_start_from_small_clusters(cells, method):
    got = stages.run_clustering(cells, ["f1", "f2", "f3"], ["N"], ClusterConfig(method, 6, discard_size=0, dissolve_size=0, micro=40))
    kept = got.cells.collect()
    blob = {r["object_id"]: min(r["object_id"] // 90, 5) for r in kept}
    seen = {}
    for r in kept:
        seen.setdefault(blob[r["object_id"]], set()).add(r["cluster"])
    assert len(got.centroids) == 6 and len({r["cluster"] for r in kept}) == 6
    assert len(seen[5]) == 1 and not seen[5] & set().union(*(seen[b] for b in range(5)))  # the far points are a cluster
