"""What must hold for results that SQL cannot recompute: fixed points, totals and moments of iterative and library fits.

Each query reports measured quantities (largest shift, cost difference, correlations …) rounded to the precision that is
promised, next to counts SQL computes on its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cellweave import fixtures as X
from cellweave.functions.scalars import fraction_limit, portable_hash_sql
from cellweave.operators import assign, classify, kmeans, normalize, silhouette
from cellweave.operators.order_stats import quantile
from cellweave.queries import base as B
from cellweave.queries import cluster_base as C
from cellweave.session import cut_lineage

W, r = B.with_sql, B.r


def _points(spark, sf):
    return B.z_cells(spark, sf).select("object_id", "vec").persist()


def _shift(table, centroids) -> float:
    """Largest difference between a centre and what its members make of it."""
    found, _ = assign.centroid_matrix(table, *centroids.shape)
    return float(np.nanmax(np.abs(found - centroids)))


def _totals(assigned, **measured):
    return assigned.agg(F.count("*").alias("n_cells")).select(
        "n_cells", *[(F.round(F.lit(float(v)), 6) + F.lit(0.0)).alias(k) for k, v in measured.items()])


def kmeans_fixed_point(spark, sf):
    """Run to zero swaps: the means of the members are the centres, and no cell changes."""
    z = _points(spark, sf)
    fit = kmeans.swap_kmeans(z, "vec", 4, 0)
    a = kmeans.assign(z, "vec", fit)
    return _totals(a, shift=_shift(assign.centroids_of(a, "vec", C.P), fit.centroids), changed=fit.changed[-1])


def kmedians_fixed_point(spark, sf):
    z = _points(spark, sf)
    fit = kmeans.kmedians(z, "vec", 4)
    a = kmeans.assign(z, "vec", fit)
    long = cut_lineage(a.select("cluster", F.posexplode("vec").alias("feature", "value")))
    gap = max(abs(fit.centroids[x["cluster"], x["feature"]] - x["m"])
              for x in quantile(long, ["cluster", "feature"], "value", 0.5, "m").collect())
    return _totals(a, shift=gap, changed=fit.changed[-1])


def kmedoids_fixed_point(spark, sf):
    """The medoid of every cluster around the final medoids is the medoid itself."""
    pts = X.points(spark, sf).select("object_id", "vec").persist()
    c, ids, costs = silhouette.kmedoids(pts, "vec", 4)
    a = assign.assign_nearest(pts, "vec", c)
    again = {x["cluster"]: x["object_id"] for x in silhouette.medoids(a, "vec").select("cluster", "object_id").collect()}
    moved = sum(again[i] != x for i, x in enumerate(ids) if i in again)
    rising = sum(b > a_ + 1e-9 for a_, b in zip(costs, costs[1:]))
    return _totals(a, moved=moved, rising_rounds=rising)


def library_kmeans_cost(spark, sf):
    """The cost the library reports is the sum of squared distances to its centres."""
    z = _points(spark, sf)
    c, cost = kmeans.library_kmeans(z.select("vec"), "vec", 5)
    a = assign.assign_nearest(z, "vec", c)
    own = a.agg(F.sum(F.pow(F.array_min("dist"), 2))).first()[0]
    return _totals(a, cost_difference=abs(own - cost) / max(cost, 1e-12))


def gaussian_mixture_totals(spark, sf):
    """Every cell has one component, the likeliest of three."""
    out = kmeans.gaussian_mixture(B.z_cells(spark, sf).select("object_id", "vec"), "vec", 3)
    return out.agg(F.count("*").alias("n_cells"), F.sum((~F.col("cluster").between(0, 2)).cast("bigint")).alias("n_outside"),
                   F.sum((~F.col("probability").between(1 / 3 - 1e-9, 1 + 1e-9)).cast("bigint")).alias("n_unlikely"))


def _component_moments(df, n):
    c = F.col("components")
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    return df.agg(F.count("*").alias("n_points"), *[F.var_pop(c[i]).alias(f"v{i}") for i in range(n)],
                  *[F.covar_pop(c[i], c[j]).alias(f"c{i}{j}") for i, j in pairs]).first()


def pca_moments(spark, sf):
    """Components are uncorrelated, their variances fall, and no direction has a larger one than the first."""
    pts = X.points(spark, sf).persist()
    m = _component_moments(normalize.pca_projection(pts, "vec", 3), 3)
    v = F.col("vec")
    own = pts.agg(*[F.var_pop(v[i]) for i in range(64)]).first()
    rises = int(m["v0"] + 1e-12 < m["v1"]) + int(m["v1"] + 1e-12 < m["v2"]) + int(max(own) > m["v0"] + 1e-9)
    return pts.sparkSession.createDataFrame([(m["n_points"], rises)], "n_points bigint, n_rises int").select(
        "n_points", "n_rises", *[(F.round(F.lit(float(m[k])), 6) + F.lit(0.0)).alias(k) for k in ("c01", "c02", "c12")])


def ica_moments(spark, sf):
    """Independent components have unit variance and no correlation."""
    z = B.z_cells(spark, sf).select("object_id", "vec").persist()
    m = _component_moments(normalize.ica_projection(z, "vec", 4, 3), 3)
    return spark.createDataFrame([(m["n_points"],)], "n_cells bigint").select(
        "n_cells", *[(F.round(F.lit(float(m[k])), 4) + F.lit(0.0)).alias(k) for k in ("v0", "v1", "v2", "c01", "c02", "c12")])


def confusion_totals(spark, sf):
    """Cells counted per label are the labelled cells outside the training part."""
    return classify.confusion_matrix(B.z_cells(spark, sf), ["treatment", "replicate"], "vec", "seed_key").groupBy("label").agg(
        F.sum("n").alias("n_cells"))


_SETTLED = "count(*) AS n_cells, 0.0::DOUBLE AS shift, 0.0::DOUBLE AS changed"
_TEST_PART = f"{portable_hash_sql('seed_key', 1)} >= {fraction_limit(0.5)}"

QUERIES = {
    "kmeans_fixed_point": (kmeans_fixed_point, W(B.Z, f"SELECT {_SETTLED} FROM z")),
    "kmedians_fixed_point": (kmedians_fixed_point, W(B.Z, f"SELECT {_SETTLED} FROM z")),
    "kmedoids_fixed_point": (kmedoids_fixed_point, "SELECT count(*) AS n_cells, 0.0::DOUBLE AS moved, 0.0::DOUBLE AS rising_rounds FROM embeddings"),
    "library_kmeans_cost": (library_kmeans_cost, W(B.Z, "SELECT count(*) AS n_cells, 0.0::DOUBLE AS cost_difference FROM z")),
    "gaussian_mixture_totals": (gaussian_mixture_totals, W(B.Z, "SELECT count(*) AS n_cells, 0::BIGINT AS n_outside, 0::BIGINT AS n_unlikely FROM z")),
    "pca_moments": (pca_moments, """SELECT count(*) AS n_points, 0 AS n_rises, 0.0::DOUBLE AS c01, 0.0::DOUBLE AS c02, 0.0::DOUBLE AS c12 FROM embeddings"""),
    "ica_moments": (ica_moments, W(B.Z, """SELECT count(*) AS n_cells, 1.0::DOUBLE AS v0, 1.0::DOUBLE AS v1, 1.0::DOUBLE AS v2, 0.0::DOUBLE AS c01,
       0.0::DOUBLE AS c02, 0.0::DOUBLE AS c12 FROM z""")),
    "confusion_totals": (confusion_totals, W(B.Z, f"""SELECT treatment || '_' || replicate AS label, count(*) AS n_cells FROM z
       WHERE {_TEST_PART} GROUP BY 1""")),
}
