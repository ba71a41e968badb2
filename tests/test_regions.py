"""Work on compact regions against brute force, with the share of the work that was needed."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweave.operators import linkage, regions, silhouette

from test_statistics import points

RNG = np.random.default_rng(23)


def dist(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))


def prim(x):
    """Sorted edge lengths of the minimum spanning tree."""
    d = dist(x, x)
    left, near, out = set(range(1, len(x))), d[0].copy(), []
    while left:
        i = min(left, key=lambda j: near[j])
        left.remove(i)
        out.append(near[i])
        near = np.minimum(near, d[i])
    return sorted(out)


def test_tree_gives_every_point_one_region_of_like_size(spark):
    x = RNG.normal(size=(800, 5))
    tree = regions.grow_tree(points(spark, x), "vec", 16, 800)
    got = {r["object_id"]: r["r"] for r in points(spark, x).select("object_id", regions.region("vec", tree).alias("r")).collect()}
    want = tree.region_of(x)
    assert [got[i] for i in range(800)] == want.tolist()
    assert tree.regions == 16 and np.bincount(want, minlength=16).max() <= 100


def test_least_distances_are_bounds():
    x, y = RNG.normal(size=(40, 3)), RNG.normal(2.0, size=(30, 3))
    ext = [np.concatenate([z.min(0), z.max(0), z.mean(0), [dist(z, z.mean(0)[None]).max()]])[None] for z in (x, y)]
    assert regions.least_distances(ext[0], ext[1], 3)[0, 0] <= dist(x, y).min()
    far = y + 50
    e = np.concatenate([far.min(0), far.max(0), far.mean(0), [dist(far, far.mean(0)[None]).max()]])[None]
    assert 40 < regions.least_distances(ext[0], e, 3)[0, 0] <= dist(x, far).min()


@pytest.mark.parametrize("shape", ["blobs", "ties"])
def test_spanning_tree_over_compact_blocks(spark, shape):
    if shape == "blobs":
        x = np.concatenate([RNG.normal(c, 0.4, size=(30, 3)) for c in (-9, -3, 2, 8, 15)])
    else:
        x = np.array([[i, j] for i in range(4) for j in range(6)] + [[1, 2]] * 20, dtype=float)
    compared = []
    edges = linkage.minimum_spanning_tree(points(spark, x), "vec", block_rows=16, compared=compared).collect()
    assert len(edges) == len(x) - 1
    np.testing.assert_allclose(sorted(e["distance"] for e in edges), prim(x), atol=1e-9)
    for e in edges:
        assert e["distance"] == pytest.approx(np.linalg.norm(x[e["lo"]] - x[e["hi"]]))
    if shape == "blobs":
        assert sum(a for a, _ in compared) < 0.4 * sum(b for _, b in compared)


def test_spanning_tree_of_nearly_equal_distances_takes_few_passes(spark):
    """Lists of nearest points settle the rounds; not every round compares the blocks again. Equal vectors hang on the smallest id."""
    x = np.random.default_rng(3).normal(size=(300, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = np.concatenate([x, x[:12], x[:3]])
    compared = []
    edges = linkage.minimum_spanning_tree(points(spark, x), "vec", block_rows=32, compared=compared).collect()
    np.testing.assert_allclose(sorted(e["distance"] for e in edges), prim(x), atol=1e-9)
    assert {(e["lo"], e["hi"]) for e in edges if e["distance"] == 0} == {(i, 300 + i) for i in range(12)} | {(i, 312 + i) for i in range(3)}
    assert len(compared) <= 3


@pytest.mark.parametrize("n", [0, 1, 2])
def test_spanning_tree_of_very_few_points(spark, n):
    df = points(spark, np.arange(2 * n, dtype=float).reshape(n, 2)) if n else points(spark, np.zeros((1, 2))).limit(0)
    assert linkage.minimum_spanning_tree(df, "vec").count() == max(0, n - 1)


def brute_medoid(x, p):
    d = dist(x, x) if p == 2 else np.abs(x[:, None] - x[None]).sum(-1)
    return d.sum(1).argmin(), d.sum(1).min()


@pytest.mark.parametrize("p, few", [(2, True), (1, True), (2, False)])
def test_medoids_by_elimination(spark, monkeypatch, p, few):
    if not few:
        monkeypatch.setattr(silhouette, "FEW", 0)
    x = np.concatenate([RNG.normal(c, 0.7, size=(n, 3)) for c, n in ((-5, 900), (0, 1), (6, 500))] + [np.full((40, 3), 30.0)])
    label = np.repeat([0, 1, 2, 3], [900, 1, 500, 40])
    df = points(spark, x, cluster=[int(c) for c in label]).selectExpr("object_id", "vec", "cast(cluster as int) cluster")
    work = {}
    got = {r["cluster"]: r for r in silhouette.medoids(df, "vec", p, block_rows=100, work=work).collect()}
    for c in range(4):
        own = np.flatnonzero(label == c)
        at, cost = brute_medoid(x[own], p)
        assert got[c]["object_id"] == own[at] and got[c]["cost"] == pytest.approx(cost)
        assert got[c]["vec"] == x[own[at]].tolist()
    assert work["distances"] < 0.2 * work["all"]


def test_medoids_where_nothing_can_be_eliminated(spark):
    x = np.eye(40)
    df = points(spark, x).selectExpr("object_id", "vec", "1 cluster")
    (row,) = silhouette.medoids(df, "vec", block_rows=16).collect()
    assert row["object_id"] == 0 and row["cost"] == pytest.approx(39 * np.sqrt(2))
    assert silhouette.medoids(df.limit(0), "vec").count() == 0


def test_medoids_of_nearly_equal_distances(spark):
    """Around a member in many dimensions the regions say nothing; the spread of the cluster leaves few members."""
    x = np.random.default_rng(5).normal(size=(3000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = np.flatnonzero(x @ x[0] > 0.05)
    work = {}
    df = points(spark, x[near]).selectExpr("object_id", "vec", "0 cluster")
    (row,) = silhouette.medoids(df, "vec", work=work).collect()
    at, cost = brute_medoid(x[near], 2)
    assert row["object_id"] == at and row["cost"] == pytest.approx(cost)
    assert work["distances"] < 0.3 * work["all"]


def test_spread_bounds_never_exceed_the_sums():
    for x in (RNG.normal(size=(200, 4)), RNG.exponential(size=(100, 2)) ** 3, np.repeat([[1.0, 2.0], [1e3, 5.0]], 7, axis=0), np.ones((5, 3))):
        m = x.mean(0)
        z = x - m
        w = (z * z).sum(1)
        h = np.column_stack([w - w.mean(), z])
        low = silhouette._spread_bounds(x, m, w.mean(), h.T @ h, len(x))
        assert (low <= dist(x, x).sum(1) * (1 + 1e-9) + 1e-9).all()


def test_manhattan_medoids_of_nearly_equal_distances(spark):
    """Sums of Manhattan distances split into features: bins leave few members where regions say nothing."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2500, 32))
    x = np.concatenate([x / np.linalg.norm(x, axis=1)[:, None], np.round(rng.normal(1e4, 2, size=(400, 32)))])
    label = np.repeat([3, 8], [2500, 400])
    work = {}
    df = points(spark, x, cluster=[int(c) for c in label]).selectExpr("object_id", "vec", "cast(cluster as int) cluster")
    got = {r["cluster"]: r for r in silhouette.medoids(df, "vec", 1, work=work).collect()}
    for c in (3, 8):
        own = np.flatnonzero(label == c)
        at, cost = brute_medoid(x[own], 1)
        assert got[c]["object_id"] == own[at] and got[c]["cost"] == pytest.approx(cost)
    assert work["distances"] < 0.05 * work["all"]


def test_bins_never_exceed_the_sums():
    for x in (RNG.normal(size=(200, 4)), RNG.exponential(size=(100, 2)) ** 3, np.repeat([[1.0, 2.0], [1e3, 5.0]], 7, axis=0), np.full((5, 3), 1e6)):
        for many in (1, 3, 30):
            cuts = np.sort(RNG.choice(x.ravel(), size=(x.shape[1], many)), axis=1)
            n, s = np.zeros((2, x.shape[1], many + 1))
            for f, k in enumerate(cuts):
                at = np.searchsorted(k, x[:, f], side="right")
                n[f], s[f] = np.bincount(at, minlength=many + 1), np.bincount(at, x[:, f] - k[many // 2], many + 1)
            cost = np.abs(x[:, None] - x[None]).sum((1, 2))
            low = silhouette._Bins(cuts, n, s).bounds(x)
            assert (low <= cost * (1 + 1e-9) + 1e-9).all()
            if many == 30 and x.shape[1] == 4:
                assert (low > 0.95 * cost).all()


def test_two_groups_meet_once(spark):
    """Distances are symmetric: n groups meet n (n + 1) / 2 times, and every point is copied n times whatever the rows."""
    def run(one, other, itself):
        yield pa.table({"a": [len(one.x)], "b": [len(other.x)], "itself": [itself]})

    df = points(spark, RNG.normal(size=(300, 4)))
    met = silhouette._meetings(df, "object_id", "vec", F.lit(0), run, "a bigint, b bigint, itself boolean", 50, 300).collect()
    assert len(met) == 21 and sum(r["itself"] for r in met) == 6
    assert sum(r["a"] * r["b"] * (1 if r["itself"] else 2) for r in met) == 300 * 300


@pytest.mark.parametrize("width", [2, 9])
def test_summaries_of_close_and_equal_points(spark, width):
    x = np.concatenate([RNG.normal(size=(60, width)), 1e3 + 1e-4 * RNG.normal(size=(50, width)), np.repeat(RNG.normal(size=(10, width)), 3, axis=0)])
    ids = [*range(139), 5]  # an id comes twice: its rows are no other points of each other
    label = [None if i % 20 == 7 else i % 3 for i in range(140)]
    df = spark.createDataFrame([(i, v, c) for i, v, c in zip(ids, x.tolist(), label)], "object_id bigint, vec array<double>, cluster int")
    d, same = dist(x, x), np.equal.outer(ids, ids)
    got = {r["object_id"]: r for r in silhouette.point_distance_summary(df, "vec", block_rows=30).collect()}
    assert len(got) == 139
    for i in range(139):
        rows = [k for k in range(140) if ids[k] == i]
        own = d[rows][~same[rows]]
        assert got[i]["mean_distance"] == pytest.approx(own.mean(), rel=1e-9)
        assert got[i]["nearest"] == pytest.approx(own.min(), rel=1e-9, abs=1e-12) and got[i]["farthest"] == pytest.approx(own.max(), rel=1e-9)
    one = df.filter("cluster IS NULL OR object_id <> 5")
    kept = [k for k in range(140) if ids[k] != 5]
    found = {(r["id"], r["cluster"]): r for r in silhouette.point_cluster_sums(one, "vec", block_rows=30).collect()}
    assert len(found) == 4 * len(kept)
    for k in kept:
        for c in (None, 0, 1, 2):
            members = [m for m in kept if label[m] == c]
            r = found[ids[k], c]
            assert r["own"] == label[k] and r["n"] == len(members) and r["total"] == pytest.approx(d[k, members].sum(), rel=1e-9, abs=1e-9)


def test_vectors_of_different_lengths_are_refused(spark):
    df = spark.createDataFrame([(i, [1.0] * (1 + 2 * (i % 2))) for i in range(8)], "object_id bigint, vec array<double>")
    with pytest.raises(Exception, match="different lengths"):
        silhouette.point_distance_summary(df, "vec").collect()


@pytest.mark.parametrize("local", [40, 1 << 20])
def test_components_of_paths_take_few_jobs(spark, monkeypatch, local):
    """A long path once took a round of jobs for every doubling, on all nodes; an edge to a node that is not there counts for none."""
    monkeypatch.setattr(linkage, "LOCAL", local)
    order = np.random.default_rng(2).permutation(400)
    pairs = [*zip(order[:250], order[1:250]), *zip(order[250:390], order[251:390]), (order[0], order[3]), (order[395], 1000), (order[396], 1000)]
    edges = spark.createDataFrame([(int(min(p)), int(max(p))) for p in pairs], "lo bigint, hi bigint")
    spark.sparkContext.setJobGroup(f"components-{local}", "components")
    rows = linkage.connected_components(spark.range(400).union(spark.range(3)), edges).collect()
    got = {r["id"]: r["component"] for r in rows}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{local}"))
    spark.sparkContext.setJobGroup("rest", "rest")
    want = {int(i): int(min(part)) for part in (order[:250], order[250:390], *order[390:, None]) for i in part}
    assert got == want and len(rows) == 403  # a repeated id keeps its two rows, whatever the rounds
    assert local < 1 << 20 or jobs <= 20


@pytest.mark.parametrize("local", [0, 1 << 20])
def test_links_are_followed_to_their_roots(spark, monkeypatch, local):
    monkeypatch.setattr(linkage, "LOCAL", local)
    links = spark.createDataFrame([(i, max(0, i - 1) if i < 30 else 40 if i > 40 else i) for i in range(50)], "node bigint, parent bigint")
    got = {r["node"]: r["parent"] for r in linkage._jump(links).collect()}
    assert got == {i: 0 if i < 30 else 40 if i > 40 else i for i in range(50)}
