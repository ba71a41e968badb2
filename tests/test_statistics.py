"""Order statistics, control split, moments and EDF distances against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.config import FilterConfig
from cellweave.functions import vectors
from cellweave.functions.scalars import ieee_divide, rename_wild_type
from cellweave.operators import controls, edf, moments, normalize, order_stats

RNG = np.random.default_rng(7)


def points(spark, x, **cols):
    rows = [(i, [float(v) for v in r], *[c[i] for c in cols.values()]) for i, r in enumerate(x)]
    schema = "object_id bigint, vec array<double>" + "".join(
        f", {n} {'string' if isinstance(c[0], str) else 'bigint'}" for n, c in cols.items())
    return spark.createDataFrame(rows, schema).repartition(4)


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_quantile_with_heavy_tails_ties_and_infinity(spark, q):
    values = np.concatenate([RNG.standard_cauchy(700) ** 3, np.full(300, 2.5), [np.inf] * 40, [-np.inf] * 3])
    keys = RNG.integers(0, 2, len(values))
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, values)], "k int, v double")
    got = {r["k"]: r["quantile"] for r in order_stats.quantile(df, ["k"], "v", q).collect()}
    for k in (0, 1):
        v = np.sort(values[keys == k])
        pos = q * (len(v) - 1)
        lo, hi = v[int(np.floor(pos))], v[int(np.ceil(pos))]
        want = lo if lo == hi else lo + (hi - lo) * (pos - np.floor(pos))
        assert got[k] == pytest.approx(want)


def test_quantile_does_not_depend_on_the_sketch(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "SKETCH_ACCURACY", 3)
    v = RNG.normal(size=2000)
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(8)
    assert order_stats.quantile(df, [], "v", 0.5).first()["quantile"] == pytest.approx(np.median(v))
    assert order_stats.quantile(df, [], "v", 0.25).first()["quantile"] == pytest.approx(np.quantile(v, 0.25))


def test_running_totals_spread_a_hot_key(spark):
    n = 5000
    df = spark.range(n).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    out = order_stats.distributed_rank(df, ["id"], ["k"])
    hot = [r["position"] for r in out.filter("k = 0").orderBy("id").collect()]
    assert hot == list(range(1, len(hot) + 1))


def test_trimmed_mahalanobis(spark):
    x = RNG.normal(size=(301, 3)) @ RNG.normal(size=(3, 3))
    test = RNG.normal(size=(50, 3))

    def direct(ref, t, fraction):
        def dist(r, y):
            inv = np.linalg.inv(np.cov(r.T, bias=True))
            c = y - r.mean(0)
            return ((c @ inv) * c).sum(1)
        keep = np.argsort(dist(ref, ref), kind="stable")[: int(np.round(len(ref) * fraction)) + 1]
        return dist(ref[keep], t)

    for fraction in (0.8, 0.95):
        model = controls.fit_mahalanobis(points(spark, x), "vec", 3, fraction)
        got = points(spark, test).withColumn("d", model.squared(F.col("vec"))).orderBy("object_id").collect()
        np.testing.assert_allclose([r["d"] for r in got], direct(x, test, fraction), rtol=1e-9)


def test_tied_reference_rows_are_cut_by_id(spark):
    x = np.array([[1.0, 0], [-1, 0], [0, 1], [0, -1]] * 10)
    model = controls.fit_mahalanobis(points(spark, x), "vec", 2, 0.5)
    assert model.n_reference == 21
    np.testing.assert_allclose(model.mean, x[:21].mean(0), atol=1e-12)


def test_control_split_counts_invalid_controls_as_infinite(spark):
    rows = [(i, "c" if i < 40 else "t", i % 5 > 0, float(v)) for i, v in enumerate(RNG.normal(size=80))]
    cells = spark.createDataFrame(rows, "object_id bigint, treatment string, is_valid boolean, x double").withColumn(
        "y", F.col("x") * F.col("x") + F.col("object_id") * 0.01)
    out = controls.split_controls(cells, FilterConfig(("x", "y"), ("c",), 1.0, 1.0))
    got = out.cells.collect()
    d = np.array([r["mahal_dist"] for r in got if r["treatment"] == "c"])
    assert np.isinf(d).sum() == 8
    med = np.median(d)
    assert out.median == pytest.approx(med)
    assert out.upper == pytest.approx(med + np.median(np.abs(d - med)))
    assert not any(r["is_non_control"] for r in got if not r["is_valid"])


def test_no_features_makes_every_valid_cell_non_control(spark):
    cells = spark.createDataFrame([(1, "c", True), (2, "t", False)], "object_id bigint, treatment string, is_valid boolean")
    out = controls.split_controls(cells, FilterConfig((), ("c",))).cells.orderBy("object_id").collect()
    assert [r["is_non_control"] for r in out] == [True, False]
    assert all(np.isnan(r["mahal_dist"]) for r in out)


def test_wide_and_unrolled_expressions_agree(spark, monkeypatch):
    x, c = RNG.normal(size=(60, 5)), RNG.normal(size=(4, 5))
    df = points(spark, x)
    inv = np.cov(x.T, bias=True)
    for p in (1, 2, 3):
        narrow = df.select("object_id", vectors.centroid_distances(F.col("vec"), c, p).alias("d")).orderBy("object_id").collect()
        monkeypatch.setattr(vectors, "UNROLL_TERMS", 0)
        wide = df.select("object_id", vectors.centroid_distances(F.col("vec"), c, p).alias("d"),
                         vectors.quadratic_form(F.col("vec"), c[0], inv).alias("q"),
                         vectors.linear_map(F.col("vec"), inv).alias("m")).orderBy("object_id").collect()
        monkeypatch.undo()
        np.testing.assert_allclose([r["d"] for r in narrow], [r["d"] for r in wide], atol=1e-9)
        np.testing.assert_allclose([r["m"] for r in wide], x @ inv, atol=1e-9)
        np.testing.assert_allclose([r["q"] for r in wide], (((x - c[0]) @ inv) * (x - c[0])).sum(1), atol=1e-9)


def test_wide_covariance(spark):
    x = RNG.normal(size=(200, 30)) + 1000.0
    m = moments.moments(points(spark, x), "vec", 30)
    np.testing.assert_allclose(m.cov, np.cov(x.T, bias=True), atol=1e-9)
    white = moments.whitening_matrix(m.cov)
    np.testing.assert_allclose(white @ m.cov @ white.T, np.eye(30), atol=1e-8)


def test_ica_recovers_independent_sources(spark):
    s = np.column_stack([RNG.uniform(-1, 1, 1500), RNG.laplace(size=1500)])
    x = s @ np.array([[1.0, 0.6], [0.4, 1.0]])
    out = normalize.ica_projection(points(spark, x).persist(), "vec", 2, 2).orderBy("object_id").collect()
    y = np.array([r["components"] for r in out])
    corr = np.abs(np.corrcoef(y.T, s.T)[:2, 2:])
    assert corr.max(axis=1).min() > 0.95


def test_ks_with_ties(spark):
    a, b = RNG.integers(0, 20, 150), RNG.integers(3, 25, 90)
    rows = [("f", float(v), True) for v in a] + [("f", float(v), False) for v in b]
    df = spark.createDataFrame(rows, "feature string, value double, first boolean")
    got = edf.ks_by_feature(df, F.col("first"), ~F.col("first")).first()["ks"]
    grid = np.arange(30)
    want = np.max(np.abs((a[:, None] <= grid).mean(0) - (b[:, None] <= grid).mean(0)))
    assert got == pytest.approx(want)


def test_scalars(spark):
    row = spark.range(1).select(
        ieee_divide(F.lit(1.0), F.lit(0.0)).alias("a"), ieee_divide(F.lit(-1.0), F.lit(0.0)).alias("b"),
        ieee_divide(F.lit(0.0), F.lit(0.0)).alias("c"), rename_wild_type(F.lit("wt1-wt")).alias("d"),
        rename_wild_type(F.lit("xwt")).alias("e")).first()
    assert (row["a"], row["b"], row["d"], row["e"]) == (np.inf, -np.inf, "mock1-mock", "xwt") and np.isnan(row["c"])


def test_ks_of_four_hundred_groups_equals_brute_force(spark):
    """Ties, one hot feature over many partitions, groups without a value, NaN; every pair against sorted samples."""
    r = np.random.default_rng(3)
    rows = [("hot", int(g), float(v)) for g, v in zip(r.integers(0, 400, 12_000), np.round(r.normal(size=12_000), 2))]
    rows += [("rare", int(g), float(v)) for g, v in zip(r.integers(0, 5, 60), r.integers(0, 4, 60))]
    rows += [("rare", 1, float("nan")), ("rare", 2, None), ("rare", None, 1.0)]
    long = spark.createDataFrame(rows, "feature string, grp int, value double")
    got = {(x["feature"], x["group_i"], x["group_j"]): x["ks"] for x in edf.pairwise_ks(long, "grp", list(range(400))).collect()}
    assert len(got) == 2 * 400 * 399 // 2
    for feature in ("hot", "rare"):
        samples = {}
        for f, g, v in rows:
            if f == feature and g is not None and v is not None:
                samples.setdefault(g, []).append(np.inf if np.isnan(v) else v)
        grid = np.unique(np.concatenate(list(samples.values())))
        f = {g: np.searchsorted(np.sort(x), grid, side="right") / len(x) for g, x in samples.items()}
        for (name, i, j), ks in got.items():
            if name == feature:
                assert np.isnan(ks) if i not in f or j not in f else ks == np.abs(f[i] - f[j]).max()


def test_group_map_of_wide_points_equals_brute_force(spark, sf):
    """64 components, a hot group, a NULL key and small blocks; moments, trimming and mean forms against NumPy."""
    from cellweave.operators import validation

    got = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id", "CAST(embedding AS array<double>) AS vec", "label").collect()
    rows = [(r["vec_id"], list(map(float, r["vec"])), "hot" if r["label"] < 6 else "cold") for r in got]
    x, g = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    df = spark.createDataFrame(rows + [(-1, [0.0] * 64, None), (-2, None, "hot")], "object_id bigint, vec array<double>, g string").repartition(7)
    found = {r["g"]: r for r in moments.grouped_moments(df, ["g"], "vec", 64).collect()}
    assert set(found) == {"hot", "cold", None} and found[None]["n"] == 1
    for k in ("hot", "cold"):
        assert found[k]["n"] == (g == k).sum()
        np.testing.assert_allclose(found[k]["mean"], x[g == k].mean(axis=0), atol=1e-12)
        np.testing.assert_allclose(np.reshape(found[k]["cov"], (64, 64)), np.cov(x[g == k].T, bias=True), atol=1e-12)
    ids = np.array([r[0] for r in rows])
    far = {(r["row_group"], r["col_group"]): r["distance"] for r in validation.mahalanobis_group_map(df.filter("g is not null and vec is not null"), "g", "vec", 64, 0.9).collect()}

    def form(y, ref):
        gap = y - ref.mean(axis=0)
        return np.einsum("ni,ij,nj->n", gap, np.linalg.inv(np.cov(ref.T, bias=True)), gap)

    for a in ("hot", "cold"):
        own = x[g == a]
        n = len(own)
        order = np.lexsort((ids[g == a], form(own, own)))[:min(n, round(n * 0.9) + 1)]
        for b in ("hot", "cold"):
            assert far[a, b] == pytest.approx(form(x[g == b], own[order]).mean(), rel=1e-6)


def test_bootstrap_count_rounds():
    assert [edf.bootstrap_count(n) for n in (0, 4, 5, 14, 15, 1994, 1995, 10_000)] == [0, 0, 1, 1, 2, 199, 200, 200]


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_resamples_equal_one_by_one(spark, partitions):
    """Vectors of running counts against each pair alone: ties, many partitions, an empty half."""
    from cellweave.functions.scalars import in_fraction

    r = np.random.default_rng(1)
    rows = [("a" if i % 3 else "b", float(np.round(r.normal(), 1)), i * 7919 + 3) for i in range(900)] + [("c", 1.0, 5), ("c", 2.0, 6), ("c", None, 7)]
    long = spark.createDataFrame(rows, "feature string, value double, k bigint")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = {(x["feature"], x["b"]): x["ks"] for x in edf.resample_ks(long, "feature", "value", "k", 6, 0.2, 11).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == 18 and np.isnan(got["c", 0])
    clean = long.filter("value is not null")
    for b in range(6):
        halves = [clean.filter(in_fraction("k", 11 + 2 * b + h, 0.2)).collect() for h in (0, 1)]
        for f in "ab":
            x, y = ([z["value"] for z in half if z["feature"] == f] for half in halves)
            grid = np.unique(x + y)
            gap = np.abs(np.searchsorted(np.sort(x), grid, "right") / len(x) - np.searchsorted(np.sort(y), grid, "right") / len(y)).max()
            assert got[f, b] == pytest.approx(gap)
