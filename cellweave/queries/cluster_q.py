"""Distances, clustering, assignment and linkage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cellweave import fixtures as X
from cellweave.functions.scalars import MODULUS, portable_hash_sql
from cellweave.operators import assign, gap, kdtree, kmeans, linkage, moments, seeds, silhouette, summaries, validation
from cellweave.operators.grouping import with_group_name
from cellweave.operators.profiles import distance_map, soft_profiles
from cellweave.queries import base as B
from cellweave.queries import cluster_base as C
from cellweave.queries.profile_q import heat_sql, soft_sql
from cellweave.session import cut_lineage

W, r = B.with_sql, B.r
WEIGHTS = [1.0, 0.5, 2.0, 0.25]


def _points(spark, sf):
    return X.points(spark, sf).select("object_id", "treatment", "replicate", "vec",
                                      F.col("treatment").cast("int").alias("cluster"))


def _start(spark, sf, k=4):
    z = B.z_cells(spark, sf).select("object_id", "vec").persist()
    seeds_, ids = kmeans.farthest_first(z, "vec", k)
    return z, seeds_, ids


# ---- distances ----------------------------------------------------------------


def _distances(p, weights=None):
    def run(spark, sf):
        z, c, _ = C.z_model(spark, sf)
        w = None if weights is None else np.array(weights)
        scored = assign.with_distances(z, "vec", c, p, w)
        return assign.explode_distances(scored, ["object_id"]).select("object_id", "cluster", r("distance"))
    return run


def point_distance_summary(spark, sf):
    return silhouette.point_distance_summary(X.points(spark, sf), "vec").select(
        "object_id", r("mean_distance"), r("nearest"), r("farthest"))


def whitened_distance_summary(spark, sf):
    """All-point Mahalanobis distances, reduced per point: whiten once, then Euclid."""
    pts = X.points(spark, sf).select("object_id", F.slice("vec", 1, 2).alias("vec"))
    m = moments.moments(pts, "vec", 2)
    white = moments.transform_features(pts, "vec", moments.whitening_matrix(m.cov), m.mean)
    return silhouette.point_distance_summary(white, "vec").select(
        "object_id", r("mean_distance"), r("nearest"), r("farthest"))


def mahalanobis_group_map(spark, sf):
    v = B.valid_cells(spark, sf).withColumn("vec", F.array("f1", "f2"))
    return validation.mahalanobis_group_map(v, "treatment", "vec", 2, 0.8).select("row_group", "col_group", r("distance"))


def mahalanobis_embedding_map(spark, sf):
    """Group map over all 64 components of the embeddings, in three groups of labels."""
    v = X.points(spark, sf).withColumn("g", (F.col("treatment") % 3).cast("string"))
    return validation.mahalanobis_group_map(v, "g", "vec", 64, 0.9).select("row_group", "col_group", r("distance", 4))


# ---- k-means family -----------------------------------------------------------


def farthest_first_seeds(spark, sf):
    _, _, ids = _start(spark, sf)
    return spark.createDataFrame(list(enumerate(ids)), "cluster int, object_id string")


def kmeans_lloyd(spark, sf):
    z, s, _ = _start(spark, sf)
    out = kmeans.lloyd(z, "vec", s, max_iter=3, tol=0.0)
    z.unpersist()
    return C.centres_frame(spark, out.centroids)


def kmeans_inertia(spark, sf):
    z, s, _ = _start(spark, sf)
    out = kmeans.lloyd(z, "vec", s, max_iter=3, tol=0.0)
    z.unpersist()
    return spark.createDataFrame(list(enumerate(out.inertia, 1)), "round int, inertia double").select(
        "round", r("inertia", 3))


def kmeans_manhattan(spark, sf):
    z, c, _ = C.z_model(spark, sf)
    z = z.select("object_id", "vec").persist()
    out = kmeans.lloyd(z, "vec", c, p=1, max_iter=2, tol=0.0)
    z.unpersist()
    return C.centres_frame(spark, out.centroids)


def kmeans_swap_threshold(spark, sf):
    z, c, _ = C.z_model(spark, sf)
    z = z.select("object_id", "vec").persist()
    out = kmeans.swap_kmeans(z, "vec", 6, 0, start=c, max_iter=3)
    z.unpersist()
    return spark.createDataFrame(list(enumerate(out.changed, 1)), "round int, changed bigint")


def kmeans_converged(spark, sf):
    """Farthest-first start, run until no point changes; sizes and centres of the fixed point."""
    z, s, _ = _start(spark, sf)
    out = kmeans.lloyd(z, "vec", s, swap_threshold=0, refill=False)
    sizes = kmeans.assign(z, "vec", out).groupBy("cluster").agg(F.count("*").alias("n_cells"))
    return sizes.join(C.centres_frame(spark, out.centroids), "cluster")


def kmedians(spark, sf):
    z, c, _ = C.z_model(spark, sf)
    z = z.select("object_id", "vec").persist()
    out = kmeans.kmedians(z, "vec", 6, start=c, max_iter=2)
    z.unpersist()
    return C.centres_frame(spark, out.centroids)


def weighted_kmeans(spark, sf):
    z, c, _ = C.z_model(spark, sf)
    z = z.select("object_id", "vec").persist()
    out, _w = kmeans.weighted_kmeans(z, "vec", 6, start=c, max_iter=2, tol=0.0)
    z.unpersist()
    return C.centres_frame(spark, out.centroids)


def robust_centres(spark, sf):
    z, c, _ = C.z_model(spark, sf)
    z = z.select("object_id", "vec").persist()
    out, _mad = kmeans.robust_centres(z, "vec", 6, 1.5, start=c, max_iter=2)
    z.unpersist()
    return C.centres_frame(spark, out.centroids)


def random_centroids(spark, sf):
    z = B.z_cells(spark, sf)
    c = kmeans.random_centroids(z, "vec", 5, 4, seed=2)
    return assign.assign_nearest(z, "vec", c).groupBy("cluster").agg(F.count("*").alias("n_cells"))


def library_kmeans(spark, sf):
    z = B.z_cells(spark, sf).select("vec").persist()
    c, cost = kmeans.library_kmeans(z, "vec", 5)
    z.unpersist()
    return C.centres_frame(spark, c).withColumn("cost", F.lit(cost))


def gaussian_mixture(spark, sf):
    z = B.z_cells(spark, sf).select("object_id", "vec")
    return kmeans.gaussian_mixture(z, "vec", 3).groupBy("cluster").agg(
        F.count("*").alias("n_cells"), F.avg("probability").alias("mean_probability"))


def cluster_medoids(spark, sf):
    return silhouette.medoids(_points(spark, sf), "vec").select("cluster", "object_id", r("cost", 4))


def cluster_medoids_manhattan(spark, sf):
    return silhouette.medoids(_points(spark, sf), "vec", p=1).select("cluster", "object_id", r("cost", 4))


def kmedoids(spark, sf):
    c, ids, costs = silhouette.kmedoids(_points(spark, sf).select("object_id", "vec"), "vec", 4)
    return spark.createDataFrame([(i, int(x), costs[-1]) for i, x in enumerate(ids)],
                                 "cluster int, object_id bigint, total_cost double")


def kd_tree(spark, sf):
    z = B.z_cells(spark, sf).select("object_id", "vec").persist()
    return kdtree.partition(z, "vec", kdtree.build_tree(z, "vec", 4, 3)).select("object_id", "cluster")


def kd_tree_assignment(spark, sf):
    """Tree grown on treatment A, every valid cell assigned."""
    z = B.z_cells(spark, sf)
    tree = kdtree.build_tree(z.filter("treatment = 'A'"), "vec", 4, 2)
    stored = kdtree.tree_from_table(kdtree.node_table(tree))
    return kdtree.partition(z, "vec", stored).groupBy("treatment", "cluster").agg(F.count("*").alias("n_cells"))


def seed_clustering(spark, sf):
    z = B.z_cells(spark, sf).select("object_id", "vec")
    return seeds.seed_clustering(z, "vec", 5).select(
        "object_id", "seed", r("distance"), F.col("merge_no").cast("bigint").alias("merge_no"), "cluster")


def random_seed_clustering(spark, sf):
    z = B.z_cells(spark, sf).select("object_id", "vec", "seed_key")
    out, c = seeds.random_seed_clustering(z, "vec", 6, seed=5, hash_col="seed_key")
    return out.groupBy("cluster").agg(F.count("*").alias("n_cells")).withColumn("n_clusters", F.lit(len(c)))


def random_seed_dump(spark, sf):
    """The same with the first half of the joins; the rest goes to the dump cluster."""
    z = B.z_cells(spark, sf).select("object_id", "vec", "seed_key")
    out, c = seeds.random_seed_clustering(z, "vec", 6, objects=z.count() // 2, seed=5, hash_col="seed_key")
    return out.groupBy("cluster").agg(F.count("*").alias("n_cells")).withColumn("n_clusters", F.lit(len(c)))


# ---- assignment and derived tables ---------------------------------------------


def nearest_centroid(spark, sf):
    z, c, _ = C.z_model(spark, sf)
    return assign.assign_nearest(z, "vec", c).select("object_id", "cluster", r(F.array_min("dist"), 6, "distance"))


def nearest_centroid_weighted(spark, sf):
    z, c, _ = C.z_model(spark, sf)
    w = np.array([[1.0 + 0.1 * k, 1.0, 0.5 + 0.1 * k, 1.0] for k in range(6)])
    return assign.assign_nearest(z, "vec", c, weights=w).select("object_id", "cluster")


def min_ess_assignment(spark, sf):
    z, c, n = C.z_model(spark, sf)
    return assign.assign_min_ess(z, "vec", c, n).select("object_id", "cluster", r(F.array_min("ess"), 6, "ess"))


def partition_centroids(spark, sf):
    z, _, _ = C.z_model(spark, sf)
    t = assign.centroids_of(z, "vec", C.P)
    return t.select("cluster", F.col("n").alias("n_cells"), *[r(F.col("centroid")[i], 6, f"c{i + 1}") for i in range(4)])


def intra_cluster_distance(spark, sf):
    z, c, _ = C.z_model(spark, sf)
    return assign.intra_cluster_distances(z, "vec", c).select("object_id", "cluster", r("own_distance"))


def inter_cluster_ess(spark, sf):
    z, _, _ = C.z_model(spark, sf)
    return assign.inter_cluster_ess(assign.centroids_of(z, "vec", C.P)).select(
        "cluster_i", "cluster_j", r("ess_change", 3))


def _average_size(assigned):
    """Discard threshold of the fixture: the average size of its six clusters."""
    return assigned.count() // 6


def _assigned(spark, sf):
    z, c, n = C.z_model(spark, sf)
    return assign.assign_nearest(z.drop("cluster"), "vec", c), c, n


def discard_small_clusters(spark, sf):
    a, _, _ = _assigned(spark, sf)
    out, _ = assign.discard_small(a, "vec", C.P, _average_size(a))
    return out.groupBy("cluster", "treatment").agg(F.count("*").alias("n_cells"))


def discard_small_reassign_all(spark, sf):
    a, _, _ = _assigned(spark, sf)
    out, _ = assign.discard_small(a, "vec", C.P, _average_size(a), reassign_all=True)
    return out.groupBy("cluster", "treatment").agg(F.count("*").alias("n_cells"))


def dissolve_small_clusters(spark, sf):
    a, c, _ = _assigned(spark, sf)
    out, _ = assign.dissolve_small(a, "vec", c, _average_size(a))
    return out.groupBy("cluster").agg(F.count("*").alias("n_cells"))


def merge_clusters(spark, sf):
    a, c, _ = _assigned(spark, sf)
    out, cent = assign.merge_clusters(a, "vec", C.P, 1, 4, 6)
    sizes = out.groupBy("cluster").agg(F.count("*").alias("n_cells"))
    return sizes.join(C.centres_frame(spark, cent), "cluster")


def merge_nearest_centroids(spark, sf):
    a, c, _ = _assigned(spark, sf)
    sizes = assign.cluster_sizes(a)
    _, mapping = assign.merge_nearest_centroids(c, [sizes.get(i, 0) for i in range(6)], 5)
    return a.withColumn("cluster", assign.relabel(F.col("cluster"), mapping)).groupBy("cluster").agg(
        F.count("*").alias("n_cells"))


def cluster_distances(spark, sf):
    """Distance to every centroid for all cells; ∞ where a cell is not clustered."""
    z, c, _ = C.z_model(spark, sf)
    out = assign.with_cluster_distances(z, "vec", c, F.col("treatment") != "N")
    return assign.explode_distances(out, ["object_id"]).select("object_id", "cluster", r("distance"))


def cluster_population(spark, sf):
    a, _, _ = _assigned(spark, sf)
    return summaries.cluster_population(a, 8)


def cluster_treatment_distribution(spark, sf):
    a, _, _ = _assigned(spark, sf)
    return summaries.cluster_treatment_distribution(a).select("cluster", "treatment", "n_cells", r("percent"))


def cluster_stddev(spark, sf):
    a, _, _ = _assigned(spark, sf)
    return summaries.cluster_stddev(a, "vec", C.P).select(
        "cluster", *[r(F.col("stddev")[i], 6, f"s{i + 1}") for i in range(4)])


def projected_spread(spark, sf):
    a, _, _ = _assigned(spark, sf)
    return summaries.projected_spread(summaries.cluster_stddev(a, "vec", C.P)).select(
        "cluster_i", "cluster_j", r("spread", 5))


def silhouette_values(spark, sf):
    return silhouette.silhouette(_points(spark, sf), "vec").select(
        "object_id", "cluster", r("a"), r("b"), r("silhouette"))


def gap_statistic(spark, sf):
    pts = X.points(spark, sf).select("object_id", "vec")
    return gap.choose_k(gap.gap_curve(pts, "vec", 64, 20, "object_id", b=5))


def within_cluster_distance(spark, sf):
    a, _, _ = _assigned(spark, sf)
    return spark.createDataFrame([(gap.within_cluster_distance(a),)], "w double").select(r("w", 5))


# ---- linkage --------------------------------------------------------------------


def _well_map(spark, sf):
    z, c, _ = C.z_model(spark, sf)
    prof = soft_profiles(with_group_name(z, ["well"]), "vec", c)
    return distance_map(prof, "l1_norm", k=6)


def _dendrogram(method):
    def run(spark, sf):
        tree, _ = linkage.group_dendrogram(_well_map(spark, sf), method)
        return tree.select("merge_no", "left", "right", r("distance"), "size")
    return run


def linkage_single_points(spark, sf):
    """Minimum spanning tree of all points in merge order."""
    return linkage.single_linkage(X.points(spark, sf), "vec").select("merge_no", "lo", "hi", r("distance"))


def cut_single_linkage(spark, sf):
    pts = X.points(spark, sf)
    merges = linkage.single_linkage(pts, "vec")
    return linkage.cut_single(pts, merges, 6)


def linkage_ward_points(spark, sf):
    """Ward linkage of the mean embeddings of the labels, weighted by their sizes."""
    v = F.col("vec")
    means = X.points(spark, sf).groupBy(F.col("treatment").alias("object_id")).agg(
        F.count("*").alias("n"), F.array(*[F.avg(v[i]) for i in range(64)]).alias("vec"))
    return linkage.ward_linkage(means, "vec", size_col="n").select("a", "b", r("distance"), "size")


def cut_linkage(spark, sf):
    return linkage.cut_groups(_well_map(spark, sf), 4)


def _merge_history(spark, sf):
    merges, names = linkage.group_merges(_well_map(spark, sf), "average")
    z = with_group_name(B.z_cells(spark, sf), ["well"])
    v = F.col("vec")
    leaves = cut_lineage(z.groupBy("group_name").agg(
        F.count("*").alias("n"), F.array(*[F.sum(v[i]) for i in range(4)]).alias("s"),
        F.array(*[F.sum(v[i] * v[i]) for i in range(4)]).alias("q")).join(names, "group_name").drop("group_name"))
    return linkage.merge_history(merges, leaves), leaves


def merge_scan(spark, sf):
    """Variance totals over the merges of the well dendrogram."""
    return linkage.merge_scan(*_merge_history(spark, sf)).select(
        "merge_no", r("total_variance"), r("mean_positive"), "n_positive")


def big_cluster_scan(spark, sf):
    """Ten merges after which most clusters have at least three groups."""
    return linkage.big_cluster_scan(*_merge_history(spark, sf), 3).orderBy(F.desc("n_big"), "merge_no").limit(10)


# ---- SQL ------------------------------------------------------------------------

SOFT_WELLS = C.MODEL + "," + soft_sql("'[' || well || ']'") + """,
sn AS (SELECT group_name, cluster, value / sum(value) OVER (PARTITION BY group_name) AS p FROM soft)"""

#: Distance of a cluster z to the union of x and y, by method: a = d(x, z), b = d(y, z), h = d(x, y).
COMBINED = {
    "single": "least(a.d, b.d)", "complete": "greatest(a.d, b.d)", "weighted": "(a.d + b.d) / 2",
    "average": "(nx.n * a.d + ny.n * b.d) / (nx.n + ny.n)",
    "ward": "sqrt(greatest((nx.n + nz.n) * a.d * a.d + (ny.n + nz.n) * b.d * b.d - nz.n * m.d * m.d, 0) / (nx.n + ny.n + nz.n))"}


def _agglomerate_sql(method: str, steps: int = 11) -> str:
    """CTEs of a linkage of the wells, merge by merge: d = distances, n = clusters, lab = leaves, m = merges."""
    parts = [f""", heat AS MATERIALIZED ({heat_sql("l1_norm", "sn")}),
g AS MATERIALIZED (SELECT group_name, row_number() OVER (ORDER BY group_name) - 1 AS id FROM (SELECT DISTINCT row_group AS group_name FROM heat)),
d0 AS MATERIALIZED (SELECT a.id AS x, b.id AS y, distance AS d FROM heat JOIN g a ON row_group = a.group_name
  JOIN g b ON col_group = b.group_name WHERE a.id <> b.id),
n0 AS MATERIALIZED (SELECT id, id AS node, 1 AS n FROM g), lab0 AS MATERIALIZED (SELECT id AS leaf, id FROM g)"""]
    for k in range(steps):
        parts.append(f""",
m{k} AS MATERIALIZED (SELECT x, y, d FROM d{k} WHERE x < y ORDER BY d, x, y LIMIT 1),
w{k} AS MATERIALIZED (SELECT a.y AS z, {COMBINED[method]} AS d FROM m{k} m JOIN d{k} a ON a.x = m.x JOIN d{k} b ON b.x = m.y AND b.y = a.y
  JOIN n{k} nx ON nx.id = m.x JOIN n{k} ny ON ny.id = m.y JOIN n{k} nz ON nz.id = a.y),
d{k + 1} AS MATERIALIZED (SELECT e.x, e.y, e.d FROM d{k} e, m{k} m WHERE e.x NOT IN (m.x, m.y) AND e.y NOT IN (m.x, m.y)
  UNION ALL SELECT m.x, z, w.d FROM w{k} w, m{k} m UNION ALL SELECT z, m.x, w.d FROM w{k} w, m{k} m),
n{k + 1} AS MATERIALIZED (SELECT c.id, CASE WHEN c.id = m.x THEN (SELECT count(*) FROM g) + {k} ELSE c.node END AS node,
  CASE WHEN c.id = m.x THEN c.n + o.n ELSE c.n END AS n FROM n{k} c, m{k} m JOIN n{k} o ON o.id = m.y WHERE c.id <> m.y),
lab{k + 1} AS MATERIALIZED (SELECT leaf, CASE WHEN l.id = m.y THEN m.x ELSE l.id END AS id FROM lab{k} l, m{k} m)""")
    return "".join(parts)


def _linkage_sql(method: str, steps: int = 11) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {k}::BIGINT AS merge_no, least(a.node, b.node) AS \"left\", greatest(a.node, b.node) AS \"right\", round(m.d, 6) + 0.0 AS distance,"
        f" (a.n + b.n)::BIGINT AS size FROM m{k} m JOIN n{k} a ON a.id = m.x JOIN n{k} b ON b.id = m.y" for k in range(steps))
    return W(SOFT_WELLS + _agglomerate_sql(method, steps), rows)


def _cut_sql(k: int) -> str:
    """Clusters after all but the last k - 1 merges of twelve wells, numbered by their smallest leaf."""
    return W(SOFT_WELLS + _agglomerate_sql("average"), f"""SELECT group_name, (dense_rank() OVER (ORDER BY l.id) - 1)::INT AS cluster
       FROM lab{12 - k} l JOIN g ON g.id = l.leaf""")


def _scan_sql() -> str:
    moments = ", ".join(f"sum(z{i + 1}) AS s{i}, sum(z{i + 1} * z{i + 1}) AS q{i}" for i in range(4))
    added = ", ".join(f"sum(s{i}) AS s{i}, sum(q{i}) AS q{i}" for i in range(4))
    variance = " + ".join(f"greatest(q{i} / n - pow(s{i} / n, 2), 0)" for i in range(4))
    ctes = f""", leaves AS MATERIALIZED (SELECT g.id AS leaf, count(*) AS n, {moments} FROM z JOIN g ON group_name = '[' || well || ']' GROUP BY 1)"""
    rows = " UNION ALL ".join(
        f"SELECT {k}::BIGINT AS merge_no, round(sum(v), 6) + 0.0 AS total_variance, round(avg(v) FILTER (v > 1e-12), 6) + 0.0 AS mean_positive,"
        f" count(*) FILTER (v > 1e-12) AS n_positive FROM (SELECT {variance} AS v FROM (SELECT l.id, sum(n) AS n, {added}"
        f" FROM lab{k + 1} l JOIN leaves USING (leaf) GROUP BY 1)) HAVING count(*) > 0" for k in range(11))
    return W(SOFT_WELLS + _agglomerate_sql("average") + ctes, rows)


def _big_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {k}::BIGINT AS merge_no, count(*) FILTER (c >= 3) AS n_big FROM (SELECT id, count(*) AS c FROM lab{k + 1} GROUP BY 1) HAVING count(*) > 0"
        for k in range(11))
    return W(SOFT_WELLS + _agglomerate_sql("average"), f"SELECT * FROM ({rows}) ORDER BY n_big DESC, merge_no LIMIT 10")


PTS = """pts AS (SELECT vec_id AS object_id, label AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def _dist_sql(p, wa=None, weights=None):
    extra = ""
    if weights:
        extra = ", (SELECT " + ", ".join(f"{w} AS w{i}" for i, w in enumerate(weights, 1)) + ") w"
    return W(C.MODEL, f"""SELECT object_id, cluster, round({C.d_sql('z', 'c', p, 4, wa)}, 6) + 0.0 AS distance
       FROM z CROSS JOIN cent{extra}""")


def _summary_sql(ctes, dist):
    return W(ctes, f"""SELECT object_id, round(avg(d), 6) + 0.0 AS mean_distance, round(min(d), 6) + 0.0 AS nearest,
       round(max(d), 6) + 0.0 AS farthest FROM (SELECT a.object_id, {dist} AS d FROM pp a JOIN pp b
       ON a.object_id <> b.object_id) GROUP BY object_id""")


def _kd_sql(depth, source):
    """Unrolled splits: node ids follow the path; leaves number left to right."""
    out = [f"k0 AS (SELECT object_id, treatment, 0 AS node, {C.Z_COLS} FROM {source})"]
    thr = []
    for d in range(depth):
        x = f"z{d % 4 + 1}"
        out.append(f"""t{d} AS MATERIALIZED (SELECT node, {x} AS v FROM (SELECT node, {x},
  row_number() OVER (PARTITION BY node ORDER BY {x}) - 1 AS rn, count(*) OVER (PARTITION BY node) AS n FROM k{d})
  WHERE rn = n // 2)""")
        out.append(f"k{d + 1} AS (SELECT object_id, treatment, node * 2 + CASE WHEN {x} < v THEN 0 ELSE 1 END AS node,"
                   f" {C.Z_COLS} FROM k{d} JOIN t{d} USING (node))")
        thr.append(x)
    return ",\n".join(out)


def _kd_assign_sql(depth):
    out = [f"q0 AS (SELECT object_id, treatment, 0 AS node, {C.Z_COLS} FROM z)"]
    for d in range(depth):
        x = f"z{d % 4 + 1}"
        out.append(f"q{d + 1} AS (SELECT object_id, treatment, node * 2 + CASE WHEN {x} < v THEN 0 ELSE 1 END AS node,"
                   f" {C.Z_COLS} FROM q{d} JOIN t{d} USING (node))")
    return ",\n".join(out)


def _seed_join_sql():
    """From ``seeds`` (cluster, object_id, s1..s4): nearest other seed, order and component labels."""
    return f"""
sj AS (SELECT object_id, min_by(seed, (d, seed)) AS seed, min(d) AS distance FROM (
  SELECT z.object_id, s.cluster AS seed, CASE WHEN z.object_id = s.object_id THEN CAST('inf' AS double)
         ELSE {C.d_sql('z.z', 's.s')} END AS d FROM z CROSS JOIN seeds s) GROUP BY 1),
so AS (SELECT *, row_number() OVER (ORDER BY distance, object_id) - 1 AS merge_no FROM sj)"""


COMPONENTS = """
link AS (SELECT s.cluster AS a, so.seed AS b FROM so JOIN seeds s USING (object_id) WHERE {taken}),
sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link UNION SELECT cluster, cluster FROM seeds),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
comp AS (SELECT a AS seed, CAST(dense_rank() OVER (ORDER BY m) - 1 AS int) AS cluster FROM (
  SELECT a, min(b) AS m FROM reach GROUP BY a))"""


def _random_sql(k, p, seed):
    rows = []
    for j in range(k):
        us = []
        for i in range(p):
            x = (j * 7919 + i * 104729 + 12345 + seed * 1013904223) % MODULUS
            u = (((x * x) % MODULUS) * 48271 + x) % MODULUS
            us.append(f"l{i + 1} + ({u} / {float(MODULUS)}) * (h{i + 1} - l{i + 1}) AS c{i + 1}")
        rows.append(f"SELECT {j} AS cluster, {', '.join(us)} FROM box")
    return ("box AS (SELECT " + ", ".join(f"min(z{i}) l{i}, max(z{i}) h{i}" for i in range(1, 5)) + " FROM z),\nrc AS ("
            + " UNION ALL ".join(rows) + ")")


START = "SELECT cluster, c1, c2, c3, c4 FROM cent"
SEED_START = "SELECT cluster, s1 AS c1, s2 AS c2, s3 AS c3, s4 AS c4 FROM seeds"
MADS = ("md AS (SELECT " + ", ".join(f"quantile_cont(z{i}, 0.5) AS q{i}" for i in range(1, 5)) + " FROM z),\n"
        "ma AS MATERIALIZED (SELECT " + ", ".join(f"quantile_cont(abs(z{i} - q{i}), 0.5) AS a{i}" for i in range(1, 5))
        + " FROM z, md)")
SPREADW = ("w AS MATERIALIZED (SELECT " + ", ".join(
    f"(a{i} - least(a1,a2,a3,a4)) / (greatest(a1,a2,a3,a4) - least(a1,a2,a3,a4)) AS w{i}" for i in range(1, 5))
    + " FROM ma)")
ROBUST = "(" + "+".join(f"CASE WHEN a{i} > 0 THEN 1 - exp(-1.5*abs(z{i}-c{i})/a{i}) ELSE 0 END" for i in range(1, 5)) + ")"


def _changed_sql(rounds):
    """Points that change cluster per round until none does."""
    parts = ["SELECT 1 AS round, count(*) AS changed FROM a1"]
    for t in range(2, rounds + 1):
        parts.append(f"SELECT {t}, count(CASE WHEN x.cluster <> y.cluster THEN 1 END) FROM a{t} x JOIN a{t - 1} y USING (object_id)")
    return " UNION ALL ".join(parts)


DISCARD_SQL = C.MODEL + f""",
kept AS (SELECT cluster AS old, CAST(row_number() OVER (ORDER BY cluster) - 1 AS int) AS new FROM (
  SELECT cluster FROM asg GROUP BY 1 HAVING count(*)   >= (SELECT count(*) // 6 FROM asg))),
closed AS (SELECT asg.* EXCLUDE (cluster, d, size), coalesce(new, -1) AS cluster FROM asg LEFT JOIN kept ON old = cluster),
nc AS (SELECT cluster AS nk, avg(z1) c1, avg(z2) c2, avg(z3) c3, avg(z4) c4 FROM closed WHERE cluster >= 0 GROUP BY 1),
near AS (SELECT object_id, treatment, cluster, min_by(nk, (d, nk)) AS best FROM (
  SELECT closed.*, nk, {C.d_sql('z', 'c')} AS d FROM closed CROSS JOIN nc) GROUP BY 1, 2, 3)"""

def _dissolve_sql() -> str:
    ctes = [C.MODEL, """lim AS (SELECT count(*) // 6 AS n FROM asg),
a0 AS MATERIALIZED (SELECT object_id, cluster FROM asg), alive0 AS (SELECT DISTINCT cluster FROM cent)"""]
    for i in range(6):
        ctes.append(f"""f{i} AS MATERIALIZED (SELECT (SELECT count(*) FROM a{i} WHERE cluster = {i}) < n AND (SELECT count(*) FROM alive{i}) > 1
  AND {i} IN (SELECT cluster FROM alive{i}) AS small FROM lim),
alive{i + 1} AS MATERIALIZED (SELECT cluster FROM alive{i}, f{i} WHERE NOT (cluster = {i} AND small)),
b{i} AS (SELECT object_id, min_by(cluster, (d, cluster)) AS best FROM cd WHERE cluster IN (SELECT cluster FROM alive{i + 1}) GROUP BY 1),
a{i + 1} AS MATERIALIZED (SELECT a.object_id, CASE WHEN small AND a.cluster = {i} THEN best ELSE a.cluster END AS cluster
  FROM a{i} a JOIN b{i} USING (object_id), f{i})""")
    return W(",\n".join(ctes), """SELECT CAST((SELECT count(*) FROM alive6 s WHERE s.cluster < a6.cluster) AS int) AS cluster, count(*) AS n_cells
       FROM a6 GROUP BY a6.cluster""")


QUERIES = {
    "point_centroid_distances": (_distances(2), _dist_sql(2)),
    "minkowski_p1": (_distances(1), _dist_sql(1)),
    "minkowski_p3": (_distances(3), _dist_sql(3)),
    "minkowski_weighted": (_distances(2, WEIGHTS), _dist_sql(2, "w.w", WEIGHTS)),
    "point_distance_summary": (point_distance_summary, _summary_sql(
        PTS + ", pp AS (SELECT * FROM pts)", "list_distance(a.v, b.v)")),
    "whitened_distance_summary": (whitened_distance_summary, _summary_sql(PTS + """,
xy AS (SELECT object_id, v[1] AS z1, v[2] AS z2 FROM pts),
zm AS (SELECT avg(z1) m1, avg(z2) m2, var_pop(z1) a, var_pop(z2) b, covar_pop(z1, z2) c FROM xy),
zs AS (SELECT *, sqrt(a*b - c*c) AS s, sqrt(a + b + 2*sqrt(a*b - c*c)) AS t FROM zm),
pp AS (SELECT object_id, (z1-m1)*(b+s)/(s*t) - (z2-m2)*c/(s*t) AS x, (z2-m2)*(a+s)/(s*t) - (z1-m1)*c/(s*t) AS y FROM xy, zs)""",
        "sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2))")),
    "mahalanobis_embedding_map": (mahalanobis_embedding_map, None),
    "mahalanobis_group_map": (mahalanobis_group_map, W(B.QC + """,
gm AS (SELECT treatment AS g, avg(f1) mx, avg(f2) my, var_pop(f1) a, var_pop(f2) b, covar_pop(f1,f2) c FROM valid GROUP BY 1),
own AS (SELECT v.*, row_number() OVER (PARTITION BY treatment ORDER BY
   ((f1-mx)*(f1-mx)*b + (f2-my)*(f2-my)*a - 2*(f1-mx)*(f2-my)*c)/(a*b-c*c), object_id) AS rn,
   count(*) OVER (PARTITION BY treatment) AS n FROM valid v JOIN gm ON g = treatment),
tm AS (SELECT treatment AS g, avg(f1) mx, avg(f2) my, var_pop(f1) a, var_pop(f2) b, covar_pop(f1,f2) c FROM own
  WHERE rn <= round_even(n*0.8, 0) + 1 GROUP BY 1)""", """SELECT g AS row_group, treatment AS col_group, round(avg(
   ((f1-mx)*(f1-mx)*b + (f2-my)*(f2-my)*a - 2*(f1-mx)*(f2-my)*c)/(a*b-c*c)), 6) + 0.0 AS distance
   FROM tm CROSS JOIN valid GROUP BY 1, 2""")),
    "farthest_first_seeds": (farthest_first_seeds, W(B.Z + ",\n" + C.seeds_sql(4), "SELECT cluster, object_id FROM seeds")),
    "kmeans_lloyd": (kmeans_lloyd, W(
        B.Z + ",\n" + C.seeds_sql(4) + ",\n" + C.lloyd_sql(SEED_START, 3), C.centres_out("r3"))),
    "kmeans_inertia": (kmeans_inertia, W(
        B.Z + ",\n" + C.seeds_sql(4) + ",\n" + C.lloyd_sql(SEED_START, 3),
        " UNION ALL ".join(f"SELECT {t} AS round, round(sum(d*d), 3) + 0.0 AS inertia FROM a{t}" for t in (1, 2, 3)))),
    "kmeans_manhattan": (kmeans_manhattan, W(
        C.MODEL + ",\n" + C.lloyd_sql(START, 2, distance=C.d_sql("z", "c", 1)), C.centres_out("r2"))),
    "kmeans_swap_threshold": (kmeans_swap_threshold, W(
        C.MODEL + ",\n" + C.lloyd_sql(START, 3), _changed_sql(3))),
    "kmeans_converged": (kmeans_converged, None),
    "kmedians": (kmedians, W(
        C.MODEL + ",\n" + C.lloyd_sql(START, 2, update="quantile_cont({x}, 0.5)"), C.centres_out("r2"))),
    "weighted_kmeans": (weighted_kmeans, W(
        C.MODEL + ",\n" + MADS + ",\n" + SPREADW + ",\n" + C.lloyd_sql(
            START, 2, distance=C.d_sql("z", "c", 2, 4, "w"), extra=" CROSS JOIN w"), C.centres_out("r2"))),
    "robust_centres": (robust_centres, W(
        C.MODEL + ",\n" + MADS + ",\n" + C.lloyd_sql(
            START, 2, update="quantile_cont({x}, 0.5)", distance=ROBUST, extra=" CROSS JOIN ma"), C.centres_out("r2"))),
    "random_centroids": (random_centroids, W(B.Z + ",\n" + _random_sql(5, 4, 2), f"""SELECT cluster, count(*) AS n_cells FROM (
       SELECT object_id, min_by(cluster, (d, cluster)) AS cluster FROM (SELECT object_id, cluster, {C.d_sql('z', 'c')} AS d
       FROM z CROSS JOIN rc) GROUP BY 1) GROUP BY 1""")),
    "library_kmeans": (library_kmeans, None),
    "gaussian_mixture": (gaussian_mixture, None),
    "cluster_medoids": (cluster_medoids, W(PTS + """,
cost AS (SELECT a.cluster, a.object_id, sum(list_distance(a.v, b.v)) AS cost FROM pts a JOIN pts b USING (cluster) GROUP BY 1, 2)""",
       """SELECT cluster, object_id, round(cost, 4) + 0.0 AS cost FROM (SELECT *, row_number() OVER (
       PARTITION BY cluster ORDER BY cost, object_id) AS rn FROM cost) WHERE rn = 1""")),
    "cluster_medoids_manhattan": (cluster_medoids_manhattan, W(PTS + """,
cost AS (SELECT a.cluster, a.object_id, sum(list_sum(list_transform(list_zip(a.v, b.v), lambda x: abs(x[1] - x[2])))) AS cost
  FROM pts a JOIN pts b USING (cluster) GROUP BY 1, 2)""",
       """SELECT cluster, object_id, round(cost, 4) + 0.0 AS cost FROM (SELECT *, row_number() OVER (
       PARTITION BY cluster ORDER BY cost, object_id) AS rn FROM cost) WHERE rn = 1""")),
    "kmedoids": (kmedoids, None),
    "kd_tree": (kd_tree, W(B.Z + ",\n" + _kd_sql(3, "z"), "SELECT object_id, CAST(node AS int) AS cluster FROM k3")),
    "kd_tree_assignment": (kd_tree_assignment, W(
        B.Z + ",\nza AS (SELECT * FROM z WHERE treatment = 'A'),\n" + _kd_sql(2, "za") + ",\n" + _kd_assign_sql(2),
        "SELECT treatment, CAST(node AS int) AS cluster, count(*) AS n_cells FROM q2 GROUP BY 1, 2")),
    "seed_clustering": (seed_clustering, "WITH RECURSIVE " + B.Z + ",\n" + C.seeds_sql(5) + "," + _seed_join_sql() + ","
                        + COMPONENTS.format(taken="true")
                        + """\nSELECT object_id, seed, round(distance, 6) + 0.0 AS distance, merge_no, cluster
       FROM so JOIN comp USING (seed)"""),
    "random_seed_clustering": (random_seed_clustering, "WITH RECURSIVE " + B.Z + f""",
seeds AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, object_id) - 1 AS int) AS cluster, object_id, s1, s2, s3, s4 FROM (
  SELECT object_id, {portable_hash_sql('seed_key', 5)} AS h, z1 AS s1, z2 AS s2, z3 AS s3, z4 AS s4 FROM z
  ORDER BY h, object_id LIMIT 6)),""" + _seed_join_sql() + "," + COMPONENTS.format(taken="true") + """,
k AS (SELECT max(cluster) + 1 AS k FROM comp),
lab AS (SELECT so.object_id, coalesce(own.cluster, c.cluster) AS cluster
  FROM so CROSS JOIN k JOIN comp c USING (seed) LEFT JOIN (
    SELECT s.object_id, comp.cluster FROM seeds s JOIN comp ON comp.seed = s.cluster) own USING (object_id))
SELECT cluster, count(*) AS n_cells, CAST((SELECT max(cluster) + 1 FROM lab) AS int) AS n_clusters FROM lab GROUP BY 1"""),
    "random_seed_dump": (random_seed_dump, "WITH RECURSIVE " + B.Z + f""",
seeds AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, object_id) - 1 AS int) AS cluster, object_id, s1, s2, s3, s4 FROM (
  SELECT object_id, {portable_hash_sql('seed_key', 5)} AS h, z1 AS s1, z2 AS s2, z3 AS s3, z4 AS s4 FROM z
  ORDER BY h, object_id LIMIT 6)),
share AS (SELECT count(*) // 2 AS n FROM z),""" + _seed_join_sql() + "," + COMPONENTS.format(taken="so.merge_no < (SELECT n FROM share)") + """,
k AS (SELECT max(cluster) + 1 AS k FROM comp),
lab AS (SELECT so.object_id, coalesce(own.cluster, CASE WHEN merge_no < (SELECT n FROM share) THEN c.cluster ELSE k END) AS cluster
  FROM so CROSS JOIN k JOIN comp c USING (seed) LEFT JOIN (
    SELECT s.object_id, comp.cluster FROM seeds s JOIN comp ON comp.seed = s.cluster) own USING (object_id))
SELECT cluster, count(*) AS n_cells, CAST((SELECT max(cluster) + 1 FROM lab) AS int) AS n_clusters FROM lab GROUP BY 1"""),
    "nearest_centroid": (nearest_centroid, W(
        C.MODEL, "SELECT object_id, cluster, round(d, 6) + 0.0 AS distance FROM asg")),
    "nearest_centroid_weighted": (nearest_centroid_weighted, W(C.MODEL, """SELECT object_id,
       min_by(cluster, (d, cluster)) AS cluster FROM (SELECT object_id, cluster, sqrt(pow((z1-c1)*(1.0+0.1*cluster), 2)
       + pow(z2-c2, 2) + pow((z3-c3)*(0.5+0.1*cluster), 2) + pow(z4-c4, 2)) AS d FROM z CROSS JOIN cent) GROUP BY 1""")),
    "min_ess_assignment": (min_ess_assignment, W(C.MODEL, """SELECT object_id, min_by(cluster, (e, cluster)) AS cluster,
       round(min(e), 6) + 0.0 AS ess FROM (SELECT object_id, cluster, size/(size+1.0)*d*d AS e FROM cd) GROUP BY 1""")),
    "partition_centroids": (partition_centroids, W(C.MODEL, """SELECT cluster, size AS n_cells,
       round(c1, 6) + 0.0 AS c1, round(c2, 6) + 0.0 AS c2, round(c3, 6) + 0.0 AS c3, round(c4, 6) + 0.0 AS c4 FROM cent""")),
    "intra_cluster_distance": (intra_cluster_distance, W(C.MODEL, f"""SELECT object_id, cluster,
       round(d, 6) + 0.0 AS own_distance FROM cd WHERE cluster = {C.LABEL}""")),
    "inter_cluster_ess": (inter_cluster_ess, W(C.MODEL, """SELECT a.cluster AS cluster_i, b.cluster AS cluster_j,
       round(a.size*b.size/CAST(a.size+b.size AS double)*(pow(a.c1-b.c1,2)+pow(a.c2-b.c2,2)+pow(a.c3-b.c3,2)+pow(a.c4-b.c4,2)), 3) + 0.0
       AS ess_change FROM cent a CROSS JOIN cent b""")),
    "discard_small_clusters": (discard_small_clusters, W(DISCARD_SQL, """SELECT
       CASE WHEN cluster < 0 THEN best ELSE cluster END AS cluster, treatment, count(*) AS n_cells FROM near GROUP BY 1, 2""")),
    "discard_small_reassign_all": (discard_small_reassign_all, W(
        DISCARD_SQL, "SELECT best AS cluster, treatment, count(*) AS n_cells FROM near GROUP BY 1, 2")),
    "dissolve_small_clusters": (dissolve_small_clusters, _dissolve_sql()),
    "merge_clusters": (merge_clusters, W(C.MODEL, """SELECT CASE WHEN cluster = 4 THEN 1 WHEN cluster > 4 THEN cluster - 1
       ELSE cluster END AS cluster, count(*) AS n_cells, round(avg(z1), 6) + 0.0 AS c1, round(avg(z2), 6) + 0.0 AS c2,
       round(avg(z3), 6) + 0.0 AS c3, round(avg(z4), 6) + 0.0 AS c4 FROM asg GROUP BY 1""")),
    "merge_nearest_centroids": (merge_nearest_centroids, W(C.MODEL + """,
pr AS (SELECT a.cluster AS i, b.cluster AS j FROM cent a JOIN cent b ON a.cluster < b.cluster
  ORDER BY pow(a.c1-b.c1,2)+pow(a.c2-b.c2,2)+pow(a.c3-b.c3,2)+pow(a.c4-b.c4,2), 1, 2 LIMIT 1)""", """SELECT
       CASE WHEN cluster = j THEN i WHEN cluster > j THEN cluster - 1 ELSE cluster END AS cluster, count(*) AS n_cells
       FROM asg, pr GROUP BY 1""")),
    "cluster_distances": (cluster_distances, W(C.MODEL, """SELECT object_id, cluster, CASE WHEN treatment <> 'N'
       THEN round(d, 6) + 0.0 ELSE CAST('inf' AS double) END AS distance FROM cd""")),
    "cluster_population": (cluster_population, W(C.MODEL, """SELECT CAST(i AS int) AS cluster, count(object_id) AS n_cells
       FROM range(8) t(i) LEFT JOIN asg ON cluster = i GROUP BY 1""")),
    "cluster_treatment_distribution": (cluster_treatment_distribution, W(C.MODEL, """SELECT cluster, treatment,
       count(*) AS n_cells, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY treatment), 6) + 0.0 AS percent
       FROM asg GROUP BY 1, 2""")),
    "cluster_stddev": (cluster_stddev, W(C.MODEL, "SELECT cluster, " + ", ".join(
        f"round(stddev_pop(z{i}), 6) + 0.0 AS s{i}" for i in range(1, 5)) + " FROM asg GROUP BY 1")),
    "projected_spread": (projected_spread, W(C.MODEL + """,
st AS (SELECT cluster, """ + ", ".join(f"avg(z{i}) m{i}, stddev_pop(z{i}) s{i}" for i in range(1, 5)) + " FROM asg GROUP BY 1)",
        "SELECT a.cluster AS cluster_i, b.cluster AS cluster_j, round((abs("
        + "+".join(f"(a.m{i}-b.m{i})*a.s{i}" for i in range(1, 5)) + ") + abs("
        + "+".join(f"(a.m{i}-b.m{i})*b.s{i}" for i in range(1, 5)) + ")) / sqrt("
        + "+".join(f"pow(a.m{i}-b.m{i}, 2)" for i in range(1, 5))
        + "), 5) + 0.0 AS spread FROM st a JOIN st b ON a.cluster <> b.cluster")),
    "silhouette": (silhouette_values, W(PTS + """,
mean_d AS (SELECT a.object_id, a.cluster AS own, b.cluster AS other, avg(list_distance(a.v, b.v)) AS m
  FROM pts a CROSS JOIN pts b GROUP BY 1, 2, 3),
ab AS (SELECT object_id, own, max(CASE WHEN own = other THEN m END) AS a, min(CASE WHEN own <> other THEN m END) AS b
  FROM mean_d GROUP BY 1, 2)""", """SELECT object_id, own AS cluster, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b,
       round((b - a) / greatest(a, b), 6) + 0.0 AS silhouette FROM ab""")),
    "gap_statistic": (gap_statistic, None),
    "within_cluster_distance": (within_cluster_distance, W(C.MODEL, """SELECT round(sum(w), 5) + 0.0 AS w FROM (
       SELECT sum(d*d)/count(*) AS w FROM asg GROUP BY cluster)""")),
    **{f"linkage_{m}_groups": (_dendrogram(m), _linkage_sql(m)) for m in linkage.TABLE_METHODS},
    "linkage_single_points": (linkage_single_points, None),
    "cut_single_linkage": (cut_single_linkage, None),
    "linkage_ward_points": (linkage_ward_points, None),
    "cut_linkage": (cut_linkage, _cut_sql(4)),
    "merge_scan": (merge_scan, _scan_sql()),
    "big_cluster_scan": (big_cluster_scan, _big_sql()),
}

