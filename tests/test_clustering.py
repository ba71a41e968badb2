"""Clustering operators against brute force and invariants on small seeded data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.functions.partials import packed_blocks
from cellweave.functions.vectors import distance_matrix, nearest_rows
from cellweave.operators import assign, blocks, gap, kdtree, kmeans, linkage, member_medians, seeds, silhouette

from test_statistics import points

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def blobs(spark):
    x = np.concatenate([RNG.normal(c, 0.3, size=(25, 3)) for c in (-3, 0, 4)])
    return x, points(spark, x).persist()


def dist(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))


def test_two_blobs_from_far_away_centres(spark):
    x = np.concatenate([RNG.normal(-1, 0.5, 5), RNG.normal(1, 0.5, 5)])[:, None]
    out = kmeans.lloyd(points(spark, x).persist(), "vec", np.array([[-10.0], [-5.0]]), tol=1e-8)
    best = np.abs(x - out.centroids.ravel()).argmin(1)
    for k in (0, 1):
        assert out.centroids[k, 0] == pytest.approx(x[best == k].mean())


def test_lloyd_is_a_fixed_point_and_inertia_never_rises(blobs, monkeypatch):
    x, df = blobs
    runs = []
    for limit in (128, 0):
        monkeypatch.setattr(kmeans, "UNROLL_TERMS", limit)
        out = kmeans.kmeans(df, "vec", 3, swap_threshold=0)
        assert all(a >= b - 1e-9 for a, b in zip(out.inertia, out.inertia[1:]))
        assert out.changed[-1] == 0
        best = dist(x, out.centroids).argmin(1)
        np.testing.assert_allclose(out.centroids, [x[best == k].mean(0) for k in range(3)], atol=1e-9)
        runs.append(out.centroids)
    np.testing.assert_allclose(runs[0], runs[1], atol=1e-9)


def test_repeated_runs_are_identical(blobs):
    _, df = blobs
    a, b = (kmeans.kmeans(df, "vec", 4, max_iter=4).centroids for _ in range(2))
    np.testing.assert_array_equal(a, b)


def test_farthest_first(blobs):
    x, df = blobs
    _, ids = kmeans.farthest_first(df, "vec", 5)
    want = [0]
    while len(want) < 5:
        want.append(int(dist(x, x[want]).min(1).argmax()))
    assert ids == want


def test_empty_cluster_takes_farthest_point(spark):
    x = np.array([[0.0], [0.1], [0.2], [5.0]])
    out = kmeans.lloyd(points(spark, x).persist(), "vec", np.array([[0.1], [-50.0]]), max_iter=3)
    assert 5.0 in out.centroids


def test_kmedoids_total_distance_falls(blobs):
    x, df = blobs
    c, ids, costs = silhouette.kmedoids(df, "vec", 3, block_rows=16)
    assert all(a >= b - 1e-9 for a, b in zip(costs, costs[1:]))
    best = dist(x, c).argmin(1)
    for k in range(3):
        rows = np.flatnonzero(best == k)
        assert ids[k] == rows[dist(x[rows], x[rows]).sum(1).argmin()]


def test_blocked_silhouette(blobs):
    x, df = blobs
    lab = np.repeat([0, 1, 2], 25)
    got = silhouette.silhouette(df.withColumn("cluster", F.floor(F.col("object_id") / 25).cast("int")), "vec",
                                block_rows=10).orderBy("object_id").collect()
    d = dist(x, x)
    a = np.array([d[i, lab == lab[i]].mean() for i in range(75)])
    b = np.array([min(d[i, lab == k].mean() for k in range(3) if k != lab[i]) for i in range(75)])
    np.testing.assert_allclose([r["silhouette"] for r in got], (b - a) / np.maximum(a, b), atol=1e-9)


def test_dissolve_matches_one_by_one(blobs):
    x, df = blobs
    cent = np.array([[-3.0] * 3, [-2.5] * 3, [0.0] * 3, [4.0] * 3, [4.3] * 3, [4.6] * 3])
    a = assign.assign_nearest(df, "vec", cent)
    got, gone = assign.dissolve_small(a, "vec", cent, 20)
    lab, d = dist(x, cent).argmin(1), dist(x, cent)
    alive = list(range(6))
    while True:
        small = [c for c in alive if (lab == c).sum() < 20]
        if not small or len(alive) == 1:
            break
        alive.remove(small[0])
        for i in np.flatnonzero(lab == small[0]):
            lab[i] = alive[int(d[i, alive].argmin())]
    want = [alive.index(c) for c in lab]
    assert [r["cluster"] for r in got.orderBy("object_id").collect()] == want
    assert gone == [c for c in range(6) if c not in alive]


def test_discard_keeps_every_point(blobs):
    x, df = blobs
    cent = np.array([[-3.0] * 3, [0.0] * 3, [4.0] * 3, [5.0] * 3])
    a = assign.assign_nearest(df, "vec", cent)
    out, c = assign.discard_small(a, "vec", 3, 10)
    assert out.filter("cluster < 0").count() == 0 and out.count() == 75 and len(c) == 3


def test_merge_nearest_centroids():
    c, mapping = assign.merge_nearest_centroids(np.array([[0.0], [10.0], [0.5], [11.0]]), [1, 3, 1, 1], 2)
    np.testing.assert_allclose(c, [[0.25], [10.25]])
    assert mapping == {0: 0, 2: 0, 1: 1, 3: 1}


def test_kd_tree_round_trip(blobs):
    x, df = blobs
    tree = kdtree.build_tree(df, "vec", 3, 3)

    def grow(idx, depth):
        if depth == 3:
            return [idx]
        col = x[idx, depth % 3]
        v = np.sort(col)[len(idx) // 2]
        return grow(idx[col < v], depth + 1) + grow(idx[col >= v], depth + 1)

    want = np.empty(75, dtype=int)
    for leaf, idx in enumerate(grow(np.arange(75), 0)):
        want[idx] = leaf
    stored = kdtree.tree_from_table(kdtree.node_table(tree))
    got = kdtree.partition(df, "vec", stored).orderBy("object_id").collect()
    assert [r["cluster"] for r in got] == list(want)


def test_kd_tree_skips_constant_dimension(spark):
    x = np.column_stack([np.ones(16), np.arange(16.0)])
    df = points(spark, x).persist()
    out = kdtree.partition(df, "vec", kdtree.build_tree(df, "vec", 2, 1))
    assert sorted(r["count"] for r in out.groupBy("cluster").count().collect()) == [8, 8]
    same = points(spark, np.ones((6, 2))).persist()
    assert kdtree.partition(same, "vec", kdtree.build_tree(same, "vec", 2, 2)).select("cluster").distinct().count() == 1


def naive_linkage(d, method):
    """Merge the closest pair again and again with the textbook update."""
    d = d.copy().astype(float)
    np.fill_diagonal(d, np.inf)
    n = {i: 1 for i in range(len(d))}
    alive, heights = list(range(len(d))), []
    while len(alive) > 1:
        h, i, j = min((d[i, j], i, j) for i in alive for j in alive if i < j)
        heights.append(h)
        for k in alive:
            if k in (i, j):
                continue
            a, b = d[i, k], d[j, k]
            v = {"single": min(a, b), "complete": max(a, b), "average": (n[i] * a + n[j] * b) / (n[i] + n[j]),
                 "weighted": (a + b) / 2,
                 "ward": np.sqrt(((n[i] + n[k]) * a * a + (n[j] + n[k]) * b * b - n[k] * h * h) / (n[i] + n[j] + n[k]))}[method]
            d[i, k] = d[k, i] = v
        n[i] += n[j]
        alive.remove(j)
    return heights


@pytest.mark.parametrize("method", linkage.TABLE_METHODS)
def test_table_linkage(spark, method):
    x = RNG.normal(size=(13, 2))
    d = dist(x, x)
    table = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(13) for j in range(13)],
                                  "row_id bigint, col_id bigint, distance double")
    ordered = linkage.ordered_merges(linkage.table_linkage(table, method))
    rows = linkage.numbered_tree(ordered, 13).orderBy("merge_no").collect()
    heights = [r["distance"] for r in rows]
    np.testing.assert_allclose(heights, naive_linkage(d, method), atol=1e-9)
    assert heights == sorted(heights) and rows[-1]["size"] == 13
    merges = [(r["a"], r["b"]) for r in ordered.orderBy("merge_no").collect()]
    assert [(r["left"], r["right"]) for r in rows] == by_hand(merges, 13)[0]
    got = {r["id"]: r["cluster"] for r in linkage.cut_tree(ordered, spark.range(13), 4).collect()}
    assert [got[i] for i in range(13)] == by_hand(merges, 13, 4)[1] and len(set(got.values())) == 4


def by_hand(merges, n, k=1):
    """Nodes of each merge, and clusters after the first n - k, one merge after another."""
    node, out, parent = list(range(n)), [], list(range(n))
    for i, (a, b) in enumerate(merges):
        out.append(tuple(sorted((node[a], node[b]))))
        node[a] = n + i
        if i < n - k:
            parent[b] = a
    for i in range(n):
        parent[i] = parent[parent[i]]  # a is smaller than b, so its own link is settled
    order = {}
    return out, [order.setdefault(parent[i], len(order)) for i in range(n)]


@pytest.mark.parametrize("shape", ["chain", "pairs"])
def test_tree_of_a_hundred_thousand_leaves(spark, shape):
    """One cluster that takes part in every merge, and a balanced tree; nothing is collected to number or cut them."""
    n = 100_000
    b = F.col("id") + 1
    low = b.bitwiseAND(-b)
    a, turn = (F.lit(0).cast("bigint"), F.lit(1)) if shape == "chain" else (b - low, F.log2(low).cast("int") + 1)
    distance = b.cast("double") if shape == "chain" else turn.cast("double")
    merges = spark.range(n - 1).select(a.alias("a"), b.alias("b"), distance.alias("distance"), F.lit(2).cast("bigint").alias("size"), turn.alias("round"))
    ordered = linkage.ordered_merges(merges)
    pairs = [(r["a"], r["b"]) for r in ordered.orderBy("merge_no").collect()]
    nodes, clusters = by_hand(pairs, n, 37)
    assert [(r["left"], r["right"]) for r in linkage.numbered_tree(ordered, n).orderBy("merge_no").collect()] == nodes
    got = linkage.cut_tree(ordered, spark.range(n), 37).orderBy("id").collect()
    assert [r["cluster"] for r in got] == clusters


def test_spanning_tree_and_cut(spark):
    x = RNG.normal(size=(30, 2))
    df = points(spark, x).persist()
    merges = linkage.single_linkage(df, "vec", block_rows=8)
    got = [r["distance"] for r in merges.orderBy("merge_no").collect()]
    np.testing.assert_allclose(got, naive_linkage(dist(x, x), "single"), atol=1e-9)
    labels = linkage.cut_single(df, merges, 5)
    assert labels.select("cluster").distinct().count() == 5 and labels.count() == 30


def test_ward_on_points(spark):
    x = RNG.normal(size=(14, 2))
    m = linkage.ward_linkage(points(spark, x), "vec", block_rows=5)
    got = sorted(r["distance"] for r in m.collect())
    np.testing.assert_allclose(got, naive_linkage(dist(x, x), "ward"), atol=1e-9)


def test_merge_scans(spark):
    merges = spark.createDataFrame([(0, 1, 1.0, 2, 1), (2, 3, 2.0, 2, 1), (0, 2, 3.0, 4, 2)], "a bigint, b bigint, distance double, size bigint, round int")
    x = np.array([0.0, 1.0, 4.0, 6.0])
    leaves = spark.createDataFrame([(i, 1, [float(v)], [float(v * v)]) for i, v in enumerate(x)], "id bigint, n bigint, s array<double>, q array<double>")
    history = linkage.merge_history(merges, leaves)
    scan = sorted(tuple(r) for r in linkage.merge_scan(history, leaves).collect())
    assert scan[0] == (0, 0.25, 0.25, 1)
    assert scan[1][1] == pytest.approx(1.25) and scan[2][1] == pytest.approx(x.var()) and scan[2][3] == 1
    assert sorted(tuple(r) for r in linkage.big_cluster_scan(history, leaves, 2).collect()) == [(0, 1), (1, 2), (2, 1)]


def test_stored_steps_keep_size_estimates_small(spark):
    """Each round joins the step before with itself; estimates must not multiply from round to round."""
    from cellweave.session import cut_lineage

    step = spark.range(500).selectExpr("id", "id AS to")
    for _ in range(6):
        step = cut_lineage(step.join(step.select("id", step["to"].alias("next")), "id").select("id", "next").toDF("id", "to"), step)
    assert step._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 32


def test_random_seed_clustering_has_a_dump(blobs):
    _, df = blobs
    out, c = seeds.random_seed_clustering(df, "vec", 4, objects=30, seed=3)
    assert out.count() == 75
    assert np.isnan(c[-1]).all()


def test_gap_finds_separated_blobs(blobs):
    _, df = blobs
    curve = gap.choose_k(gap.gap_curve(df, "vec", 3, 4, "object_id", b=3, max_iter=10))
    assert curve.first()["best_k"] == 3


def test_gap_curve_equals_single_fits(blobs):
    """All (k, box) together against one k-means after another on points that Spark makes."""
    import math

    from cellweave.operators.assign import assign_nearest

    _, df = blobs
    p = len(df.first()["vec"])
    curve = gap.gap_curve(df, "vec", p, 4, "object_id", b=2).orderBy("k").collect()
    sets = [df] + [gap.reference_points(df, "vec", p, i, "object_id") for i in range(2)]
    for r in curve:
        logs = []
        for s in sets:
            fit = kmeans.kmeans(s.select("object_id", "vec"), "vec", r["k"])
            logs.append(math.log(gap.within_cluster_distance(assign_nearest(s, "vec", fit.centroids))))
        assert r["gap"] == pytest.approx(np.mean(logs[1:]) - logs[0], rel=1e-9)
        assert r["sk"] == pytest.approx(np.std(logs[1:]) * math.sqrt(1.5), abs=1e-9)


def _blocks(spark, x):
    return packed_blocks(spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "object_id long, vec array<double>").repartition(3), "vec", 64)


def test_member_medians_are_exact(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 5, 1501) / 4.0, rng.normal(size=1501) * 1e-7 + 3.0, rng.standard_cauchy(1501) * 1e6])
    for rows in (x, x[:-1], np.repeat(x[:3], 700, axis=0), x[:1]):
        c = np.array([rows[0], rows[-1] + 0.5, [1e9, 1e9, 1e9]])
        near = np.abs(rows[:, None] - c[None]).sum(axis=2)
        best = near.argmin(axis=1)
        found, inertia, changed = member_medians.member_medians(_blocks(spark, rows), c, None, lambda a, b: distance_matrix(a, b, 1))
        want = np.array([np.median(rows[best == j], axis=0) if (best == j).any() else np.full(3, np.nan) for j in range(3)])
        assert np.allclose(found, want, rtol=1e-12, atol=0, equal_nan=True)
        assert np.isclose(inertia, near.min(axis=1).sum()) and changed == len(rows)
        assert member_medians.member_medians(_blocks(spark, rows), c, c, lambda a, b: distance_matrix(a, b, 1))[2] == 0


def test_median_rounds_are_few_passes(spark):
    """A round used to run a sketch, a histogram and two joins over one row per point and feature."""
    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(3000, 3)).tolist())], "object_id long, vec array<double>").persist()
    spark.sparkContext.setJobGroup("medians", "medians")
    fit = kmeans.kmedians(points, "vec", 3, max_iter=6)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("medians")
    spark.sparkContext.setJobGroup("", "")
    points.unpersist()
    assert len(jobs) <= 10 + 6 * fit.rounds


def test_far_points_are_cut_down_before_the_driver(spark):
    points = spark.range(5000).repartition(20).select(F.col("id").alias("object_id"), F.array(F.col("id").cast("double")).alias("vec"))
    assert kmeans.farthest_first(points, "vec", 3)[1] == [0, 4999, 2499]
    assert [v.tolist() for v in kmeans.farthest_points(points, "vec", np.array([[0.0]]), 2, 2, None, "object_id")] == [[4999.0], [4998.0]]


def test_nearest_rows_break_ties_like_the_distances(spark):
    x = np.random.default_rng(8).integers(0, 4, size=(500, 3)) / 2.0
    c = np.concatenate([x[:4], x[:2], x[4:7] + 0.25])
    d = distance_matrix(x, c)
    best, low = nearest_rows(x, c)
    assert best.tolist() == d.argmin(axis=1).tolist() and low.tolist() == d.min(axis=1).tolist()
    sums = kmeans.member_sums(x, c, None, 2, None)
    assert np.allclose(sums[:, :3], [x[best == j].sum(axis=0) for j in range(len(c))]) and sums[:, 3].tolist() == np.bincount(best, minlength=len(c)).tolist()


def test_grown_blocks_are_copied_less_and_sum_the_same(spark):
    x = np.random.default_rng(9).normal(size=(400, 3))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "object_id long, vec array<double>")

    def kernel(lids, llabels, left, rids, rlabels, right):
        return pd.DataFrame({"id": lids, "low": np.sqrt(((left[:, None] - right[None]) ** 2).sum(-1)).sum(axis=1), "size": len(lids) * len(rids)})

    rows = blocks.blocked_reduce(frame, "object_id", "vec", None, kernel, "id long, low double, size long", block_rows=8).toPandas()
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)).sum(axis=1)
    assert np.allclose(rows.groupby("id")["low"].sum().sort_index(), want)
    # 16 blocks of 25 points instead of 50 of 8: each point meets that many blocks, and a call no more pairs than some blocks of 8
    assert len(rows) == 400 * 16 and rows["size"].max() <= 4 * 64
