"""Populations, statistics, moments, control split, normalisation, EDF distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave import fixtures as X
from cellweave.config import FilterConfig
from cellweave.functions import scalars as S
from cellweave.operators import controls, edf, importance, moments, normalize, quality, summaries
from cellweave.queries import base as B
from cellweave.queries.quality_q import split, with_bad_values

W = B.with_sql
r = B.r


def filtered(spark, sf):
    return split(spark, sf).cells


def penetrance(spark, sf):
    """Flagship: quality control → z-score → trimmed Mahalanobis split → penetrance per treatment."""
    cells = B.qc_cells(spark, sf)
    valid = cells.filter("is_valid")
    scaling = normalize.fit_scaling(valid.filter(F.col("treatment") == X.CONTROL), X.FILTER.features)
    out = controls.split_controls(cells, X.FILTER, vec=scaling.vector())
    return summaries.penetrance(out.cells).select("treatment", "n_valid", "n_non_control", r("penetrance"))


def population(spark, sf):
    return summaries.population(filtered(spark, sf))


def phenotype_treatments(spark, sf):
    return summaries.phenotype_treatments(filtered(spark, sf), 0.3).select("treatment", r("penetrance"))


def penetrance_filter(spark, sf):
    return summaries.penetrance_filter(filtered(spark, sf), [X.CONTROL]).groupBy("treatment").agg(
        F.count("*").alias("n_cells"))


def distance_spread(spark, sf):
    return summaries.distance_spread(filtered(spark, sf)).select(
        "treatment", "kind", F.col("n").alias("n_cells"), r("median"), r("mad"))


def control_mean_intensity(spark, sf):
    return normalize.control_means(B.qc_cells(spark, sf), [X.CONTROL], X.FEATURES).select(
        "feature", r("mean_intensity", 4))


def intensity_normalised(spark, sf):
    return normalize.normalise_intensity(B.valid_cells(spark, sf), [X.CONTROL], ["f2", "f3"]).select(
        "object_id", r("f2", 7), r("f3", 7))


def histogram(spark, sf):
    return summaries.histogram(B.valid_cells(spark, sf), "f2", 40)


def histogram_density(spark, sf):
    cells = filtered(spark, sf).filter("is_valid").withColumn("d2", F.col("mahal_dist") * F.col("mahal_dist"))
    return summaries.histogram(cells, "d2", 49, ["treatment"], 0.0, 50.0, drop_from=500, density=True).select(
        "treatment", "bin", F.col("n").alias("n_cells"), r("density"))


def categorical_histogram(spark, sf):
    return summaries.categorical_histogram(B.coded_cells(spark, sf), "qc_code", 100.0).select(
        "qc_code", F.col("n").alias("n_cells"), r("share"))


def edf_steps(spark, sf):
    return summaries.edf_steps(B.valid_cells(spark, sf), "treatment", "f2").select("treatment", "f2", r("edf"))


def ddim_histogram(spark, sf):
    z = B.z_cells(spark, sf)
    out = summaries.ddim_histogram(z, "treatment", "vec", 3, 5, "A")
    return out.select("group_name", F.array_join("bins", ",").alias("bins"), r("density"))


def ddim_distances(spark, sf):
    z = B.z_cells(spark, sf)
    out = summaries.ddim_distances(summaries.ddim_histogram(z, "treatment", "vec", 3, 5, "A"))
    return out.select("group_i", "group_j", r("distance"), r("scaled"))


def dataset_statistics(spark, sf):
    s = split(spark, sf)
    im = quality.image_codes(X.images(spark, sf), B.coded_cells(spark, sf), X.QC)
    return summaries.dataset_statistics(s.cells, im, s.upper, s.median, s.mad).select(
        "n_cells", "n_valid_cells", "n_non_control_cells", "n_images", "n_valid_images", r("cutoff"),
        r("control_median"), r("control_mad"))


def robust_stats(spark, sf):
    return summaries.robust_stats(X.cells(spark, sf), X.FEATURES).select(
        "feature", F.col("n").alias("n_cells"), r("median", 4), r("mad", 4))


def feature_box(spark, sf):
    return summaries.feature_box(B.valid_cells(spark, sf), X.FEATURES)


# ---- moments ----------------------------------------------------------------


def covariance(spark, sf):
    z = B.z_cells(spark, sf)
    named = z.select(*[F.col("vec")[i].alias(f"z{i + 1}") for i in range(4)])
    return moments.covariance_table(named, [f"z{i + 1}" for i in range(4)]).select(
        "feature_i", "feature_j", r("covariance"))


def inverse_covariance(spark, sf):
    z = B.z_cells(spark, sf).select("vec")
    inv = moments.inverse_covariance(moments.moments(z, "vec", 2).cov)
    return spark.createDataFrame([(i, j, float(inv[i, j])) for i in range(2) for j in range(2)],
                                 "i int, j int, value double").select("i", "j", r("value"))


def label_covariances(spark, sf):
    """Covariance of all 64 components within each label."""
    rows = moments.grouped_moments(X.points(spark, sf), ["treatment"], "vec", 64)
    return rows.select(F.col("treatment").alias("label"), "n", F.posexplode("cov").alias("at", "c")).select(
        "label", "n", F.floor(F.col("at") / 64).cast("int").alias("i"), (F.col("at") % 64).cast("int").alias("j"), r("c", 8, "covariance"))


def mahalanobis_trimmed(spark, sf):
    v = B.valid_cells(spark, sf).withColumn("vec", F.array("f1", "f2"))
    out = controls.mahalanobis_squared(v.filter("treatment = 'N'"), v, "vec", 2, 0.9)
    return out.select("object_id", r("mahal_squared"))


def control_split(spark, sf):
    return filtered(spark, sf).select("object_id", r("mahal_dist"), "is_control_like", "is_non_control")


def _cutoffs(spark, sf, mode, c, valid_only):
    cells = B.coded_cells(spark, sf).withColumn("is_valid", F.col("qc_code") == 1)
    cfg = FilterConfig(("f1", "f2"), (X.CONTROL,), c, 0.9, mode, True, valid_only)
    s = controls.split_controls(cells, cfg)
    return s.cells.agg(F.sum(F.col("is_non_control").cast("bigint")).alias("n_non_control")).select(
        F.lit(mode).alias("mode"), r(F.lit(s.median), 6, "median"), r(F.lit(s.mad), 6, "mad"),
        r(F.lit(s.upper), 6, "upper"), "n_non_control")


def control_cutoff_median_mad(spark, sf):
    """Invalid control cells count as ∞ in median and MAD."""
    return _cutoffs(spark, sf, 0, 1.0, False)


def control_cutoff_median(spark, sf):
    return _cutoffs(spark, sf, 1, 1.2, False)


def control_cutoff_median_mad_limit(spark, sf):
    return _cutoffs(spark, sf, 2, 1.0, True)


def control_cutoff_median_limit(spark, sf):
    return _cutoffs(spark, sf, 3, 0.5, True)


def control_split_off(spark, sf):
    cfg = FilterConfig(("f1", "f2"), (X.CONTROL,), run_mahal_dist=False)
    return controls.split_controls(B.qc_cells(spark, sf), cfg).cells.groupBy("is_non_control").agg(
        F.count("*").alias("n_cells"))


def _whitened(spark, sf):
    z = B.z_cells(spark, sf).select("object_id", F.slice("vec", 1, 2).alias("vec"))
    m = moments.moments(z, "vec", 2)
    return z, m, moments.whitening_matrix(m.cov)


def whitening_matrix(spark, sf):
    _, _, w = _whitened(spark, sf)
    return spark.createDataFrame([(i, j, float(w[i, j])) for i in range(2) for j in range(2)],
                                 "i int, j int, value double").select("i", "j", r("value"))


def transform_features(spark, sf):
    z, m, w = _whitened(spark, sf)
    out = moments.transform_features(z, "vec", w, m.mean)
    return out.select("object_id", r(F.col("vec")[0], 6, "w1"), r(F.col("vec")[1], 6, "w2"))


def z_score(spark, sf):
    z = B.z_cells(spark, sf)
    return z.select("object_id", *[r(F.col("vec")[i], 6, f"z{i + 1}") for i in range(4)])


def z_score_bad_values(spark, sf):
    """NaN and ∞ cells drop out; an all-∞ feature and a constant one are dropped."""
    cells = with_bad_values(B.valid_cells(spark, sf)).withColumns({
        "f5": F.lit(float("inf")), "f6": F.lit(3.0)})
    out, scaling = normalize.normalise(cells, cells.filter("treatment = 'N'").withColumn("f5", F.lit(1.0)),
                                       ["f1", "f2", "f3", "f5", "f6"])
    return out.select("object_id", F.lit(",".join(scaling.features)).alias("kept"),
                      r(F.col("vec")[0], 6, "z1"), r(F.col("vec")[1], 6, "z2"))


def feature_selection(spark, sf):
    cells = B.valid_cells(spark, sf).withColumns({
        "f5": F.when(F.col("line_no") == 7, F.lit(float("nan"))).otherwise(F.col("f1")),
        "f6": F.col("f3") * 0.1, "f7": F.col("f2") * 2 + F.col("f1"), "f8": F.col("f4") + 1000.0})
    lists = normalize.select_features(cells, ["f1", "f2", "f3", "f4", "f5", "f6", "f7", "f8"])
    return spark.createDataFrame([(k, f) for k, fs in lists.items() for f in fs], "verdict string, feature string")


def pca_projection(spark, sf):
    """Variance of each principal component (axes are sign-canonical)."""
    out = normalize.pca_projection(X.points(spark, sf), "vec", 3)
    return out.select("object_id", *[r(F.col("components")[i], 6, f"pc{i + 1}") for i in range(3)])


def ica_projection(spark, sf):
    z = B.z_cells(spark, sf).select("object_id", "is_valid", "vec").persist()
    out = normalize.append_components(normalize.ica_projection(z, "vec", 4, 3), "components", 3)
    return out.select("object_id", "PCA 1", "PCA 2", "PCA 3")


def robust_distance_shapes(spark, sf):
    d, mad = F.col("f2") / 1000.0, F.lit(20.0)
    return B.valid_cells(spark, sf).select(
        "object_id", r(S.upside_down_gaussian(d, mad, 2.0), 6, "gaussian"),
        r(S.reverse_exponential(d, mad, 1.5), 6, "exponential"), r(S.fermi_dirac(d, mad, 4.0), 6, "fermi"))


def feature_importance(spark, sf):
    return importance.feature_importance(B.valid_cells(spark, sf), X.FEATURES, "f1 < 20 AND f3 < 0.05").select(
        "feature", r("importance"))


def feature_weighting(spark, sf):
    cells = B.valid_cells(spark, sf).withColumn("cluster", F.floor((F.col("f1") - 1) / 17).cast("int"))
    return importance.feature_weighting(cells, X.FEATURES).select("cluster", "feature", r("importance"))


# ---- EDF distances ----------------------------------------------------------


def _long(spark, sf, keep=()):
    return summaries.melt(B.valid_cells(spark, sf), X.FEATURES, keep)


def ks_distance(spark, sf):
    long = _long(spark, sf, ["treatment"])
    return edf.ks_by_feature(long, F.col("treatment") == "A", F.col("treatment") == "N").select("feature", r("ks"))


def edf_distance_matrix(spark, sf):
    pairs = edf.pairwise_ks(_long(spark, sf, ["treatment"]), "treatment", ["A", "N", "R"])
    return edf.edf_distance_matrix(pairs).select("group_i", "group_j", r("distance"))


def edf_weights(spark, sf):
    pairs = edf.pairwise_ks(_long(spark, sf, ["treatment"]), "treatment", ["A", "N", "R"])
    return edf.edf_weights(pairs).select("feature", r("mean_ks"), r("weight"))


def weighted_edf_map(spark, sf):
    """Distance map of the Kolmogorov-Smirnov metric: weighted by agreement between groups."""
    pairs = edf.pairwise_ks(_long(spark, sf, ["treatment"]), "treatment", ["A", "N", "R"])
    return edf.edf_distance_matrix(pairs, edf.edf_weights(pairs)).select("group_i", "group_j", r("distance"))


def ks_label_pairs(spark, sf):
    """KS distance of every two labels for each of the 64 components of the embeddings."""
    long = X.points(spark, sf).select("treatment", F.posexplode("vec").alias("feature", "value"))
    labels = [r[0] for r in long.select("treatment").distinct().orderBy("treatment").collect()]
    return edf.pairwise_ks(long, "treatment", labels).select("feature", "group_i", "group_j", r("ks"))


def ks_p_values(spark, sf):
    cells = filtered(spark, sf).filter("is_valid").withColumn("d2", F.col("mahal_dist") * F.col("mahal_dist"))
    return edf.ks_against(cells, "treatment", X.CONTROL, "d2", ["A", "N", "R"]).select(
        "group_name", r("ks"), r("p_value"))


def _bootstrap(spark, sf):
    valid = B.valid_cells(spark, sf).withColumns({
        "is_ctrl": F.col("treatment") == "N", "is_treated": F.col("treatment") != "N"})
    long = summaries.melt(valid, X.FEATURES, ["is_ctrl", "is_treated", "seed_key"])
    return edf.bootstrap_quality(long, "is_ctrl", "is_treated", "seed_key")


def bootstrap_features(spark, sf):
    return _bootstrap(spark, sf).select("feature", r("ks_treated"), r("ks_bootstrap"), r("quality"))


def best_features(spark, sf):
    return edf.best_features(_bootstrap(spark, sf), 2).select("feature", F.col("rank").cast("bigint").alias("rank"))


# ---- SQL --------------------------------------------------------------------

# the flagship split works on z-scores of f1 and f2: same distances as on raw values up to rounding
PEN = W(B.FLT, """SELECT treatment, count(CASE WHEN is_valid THEN 1 END) AS n_valid,
  count(CASE WHEN is_non_control THEN 1 END) AS n_non_control,
  round(count(CASE WHEN is_non_control THEN 1 END) / CAST(count(CASE WHEN is_valid THEN 1 END) AS double), 6) + 0.0
    AS penetrance FROM flt GROUP BY treatment""")

LONG = B.QC + """,
long AS (SELECT object_id, seed_key, treatment, unnest(['f1','f2','f3','f4']) AS feature,
                unnest([f1, f2, f3, f4]) AS value FROM valid)"""

PAIRS = LONG + """,
cnt AS (SELECT feature, value, count(CASE WHEN treatment='A' THEN 1 END) a,
               count(CASE WHEN treatment='N' THEN 1 END) n, count(CASE WHEN treatment='R' THEN 1 END) r
        FROM long GROUP BY 1, 2),
cum AS (SELECT feature, sum(a) OVER w / sum(a) OVER (PARTITION BY feature) fa,
               sum(n) OVER w / sum(n) OVER (PARTITION BY feature) fn,
               sum(r) OVER w / sum(r) OVER (PARTITION BY feature) fr
        FROM cnt WINDOW w AS (PARTITION BY feature ORDER BY value)),
ks AS (SELECT feature, 'A' AS group_i, 'N' AS group_j, max(abs(fa - fn)) AS ks FROM cum GROUP BY 1
       UNION ALL SELECT feature, 'A', 'R', max(abs(fa - fr)) FROM cum GROUP BY 1
       UNION ALL SELECT feature, 'N', 'R', max(abs(fn - fr)) FROM cum GROUP BY 1),
km AS (SELECT feature, avg(ks) AS mean_ks FROM ks GROUP BY 1),
kw AS (SELECT feature, mean_ks, ((SELECT max(mean_ks) FROM km) - mean_ks) AS g FROM km),
kwn AS (SELECT feature, mean_ks, g / sqrt((SELECT sum(g*g) FROM kw)) AS weight FROM kw)"""


def _both_ways(body: str) -> str:
    return (f"SELECT group_i, group_j, round(d, 6) + 0.0 AS distance FROM ({body})"
            f" UNION ALL SELECT group_j, group_i, round(d, 6) + 0.0 FROM ({body})")


def _bootstrap_sql() -> str:
    m = S.MODULUS
    return LONG + f""",
ctl AS (SELECT feature, value, seed_key % {m} AS k FROM long WHERE treatment = 'N'),
number AS (SELECT least(floor(0.1 * (SELECT count(*) FROM valid WHERE treatment = 'N') + 0.5)::INT, 200) AS nb),
pairs AS (SELECT t.i // 2 AS b, t.i % 2 AS half, (11 + t.i) * 1013904223 % {m} AS s FROM number, range(nb * 2) t(i)),
keys AS (SELECT k, b, half FROM (SELECT DISTINCT k FROM ctl), pairs
  WHERE ((k + s) % {m} * ((k + s) % {m}) % {m} * 48271 + (k + s) % {m}) % {m} < {S.fraction_limit(0.2)}),
samples AS (SELECT feature, value, b, half FROM ctl JOIN keys USING (k)),
bc AS (SELECT feature, b, value, count(CASE WHEN half=0 THEN 1 END) a, count(CASE WHEN half=1 THEN 1 END) c
       FROM samples GROUP BY 1, 2, 3),
bcum AS (SELECT feature, b, sum(a) OVER w / sum(a) OVER (PARTITION BY feature, b) fa,
                sum(c) OVER w / sum(c) OVER (PARTITION BY feature, b) fc
         FROM bc WINDOW w AS (PARTITION BY feature, b ORDER BY value)),
boot AS (SELECT feature, avg(ks) AS ks_bootstrap FROM (
           SELECT feature, b, max(abs(fa - fc)) AS ks FROM bcum GROUP BY 1, 2) GROUP BY 1),
tc AS (SELECT feature, value, count(CASE WHEN treatment='N' THEN 1 END) a,
              count(CASE WHEN treatment<>'N' THEN 1 END) c FROM long GROUP BY 1, 2),
tcum AS (SELECT feature, sum(a) OVER w / sum(a) OVER (PARTITION BY feature) fa,
                sum(c) OVER w / sum(c) OVER (PARTITION BY feature) fc
         FROM tc WINDOW w AS (PARTITION BY feature ORDER BY value)),
quality AS (SELECT feature, ks_treated, ks_bootstrap, ks_treated - ks_bootstrap AS quality
            FROM (SELECT feature, max(abs(fa - fc)) AS ks_treated FROM tcum GROUP BY 1) JOIN boot USING (feature))"""


def _cutoff_sql(mode: int, c: float, valid_only: bool) -> str:
    ctes = B.TRIM.replace("(c.qc_code = 1 AND i.image_code = 0) AS is_valid", "(c.qc_code = 1) AS is_valid")
    which = "treatment = 'N'" + (" AND is_valid" if valid_only else "")
    base = f"med + {c} * mad" if mode in (0, 2) else f"{c} * med"
    upper = base
    if mode in (2, 3):
        upper = (f"CASE WHEN (SELECT count(*) FROM chosen WHERE is_valid AND mahal_dist > {base}) >"
                 f" 0.1 * (SELECT count(*) FROM chosen) THEN (SELECT mahal_dist FROM ranked WHERE"
                 f" rn = least(CAST(floor(0.9 * n + 1) AS bigint), n - 1)) ELSE {base} END")
    return ctes + f""",
chosen AS (SELECT * FROM dist WHERE {which}),
ranked AS (SELECT mahal_dist, row_number() OVER (ORDER BY mahal_dist) - 1 AS rn, count(*) OVER () AS n FROM chosen),
med AS (SELECT quantile_cont(mahal_dist, 0.5) AS med FROM chosen),
mad AS (SELECT quantile_cont(abs(mahal_dist - med), 0.5) AS mad FROM chosen, med),
cut AS (SELECT med, mad, {upper} AS upper FROM med, mad)
SELECT {mode} AS mode, round(med, 6) + 0.0 AS median, round(mad, 6) + 0.0 AS mad, round(upper, 6) + 0.0 AS upper,
       (SELECT count(*) FROM dist WHERE is_valid AND mahal_dist > upper) AS n_non_control FROM cut"""


def _imp_sql(src: str, keys: str) -> str:
    on = " USING (feature)"
    return B.QC + f""",
base AS (SELECT floor((f1 - 1) / 17)::int AS cluster, f1 < 20 AND f3 < 0.05 AS member,
                unnest(['f1','f2','f3','f4']) AS feature, unnest([f1, f2, f3, f4]) AS value FROM valid),
am AS (SELECT feature, quantile_cont(value, 0.5) AS med FROM base GROUP BY 1),
aa AS (SELECT feature, quantile_cont(abs(value - med), 0.5) AS mad_all FROM base JOIN am{on} GROUP BY 1),
sm AS (SELECT {keys}, quantile_cont(value, 0.5) AS med, count(*) AS n FROM base {src} GROUP BY {keys}),
sa AS (SELECT {keys}, any_value(n) AS n, quantile_cont(abs(value - med), 0.5) AS mad
       FROM base JOIN sm USING ({keys}) {src} GROUP BY {keys}),
im AS (SELECT {keys}, n, CASE WHEN mad > 0 AND mad_all > 0 THEN 1 - mad / mad_all END AS i FROM sa JOIN aa{on})"""


def _imp_select(part: str, keys: str) -> str:
    return f"""SELECT {keys}, round(CASE WHEN n < 2 THEN 1.0 WHEN i IS NULL THEN -1.0
  WHEN max(i) OVER w - min(i) OVER w > 0 THEN (i - min(i) OVER w) / (max(i) OVER w - min(i) OVER w)
  ELSE i - min(i) OVER w END, 6) + 0.0 AS importance FROM im WINDOW w AS ({part})"""


WHITE = B.Z + """,
zm AS (SELECT avg(z1) m1, avg(z2) m2, var_pop(z1) a, var_pop(z2) b, covar_pop(z1, z2) c FROM z),
zs AS (SELECT *, sqrt(a*b - c*c) AS s, sqrt(a + b + 2*sqrt(a*b - c*c)) AS t FROM zm),
wm AS (SELECT m1, m2, (b + s)/(s*t) AS w11, -c/(s*t) AS w12, (a + s)/(s*t) AS w22 FROM zs)"""

DDIM = B.Z + """,
edge AS (SELECT min(z1) l1, max(z1) h1, min(z2) l2, max(z2) h2, min(z3) l3, max(z3) h3 FROM z WHERE treatment = 'A'),
binned AS (SELECT treatment AS group_name,
    least(CAST(floor((z1-l1)/((h1-l1)/5)) AS int), 4) AS b1, least(CAST(floor((z2-l2)/((h2-l2)/5)) AS int), 4) AS b2,
    least(CAST(floor((z3-l3)/((h3-l3)/5)) AS int), 4) AS b3, ((h1-l1)/5)*((h2-l2)/5)*((h3-l3)/5) AS vol
  FROM z, edge WHERE z1 BETWEEN l1 AND h1 AND z2 BETWEEN l2 AND h2 AND z3 BETWEEN l3 AND h3),
hist AS (SELECT group_name, b1, b2, b3, count(*) / (sum(count(*)) OVER (PARTITION BY group_name) * any_value(vol)) AS density
  FROM binned GROUP BY 1, 2, 3, 4)"""

QUERIES = {
    "penetrance": (penetrance, PEN),
    "population": (population, W(B.FLT, """SELECT treatment, count(CASE WHEN is_valid THEN 1 END) AS n_valid,
       count(CASE WHEN is_non_control THEN 1 END) AS n_non_control FROM flt GROUP BY 1""")),
    "phenotype_treatments": (phenotype_treatments, W(B.FLT, """SELECT * FROM (SELECT treatment,
       round(count(CASE WHEN is_non_control THEN 1 END) / CAST(count(CASE WHEN is_valid THEN 1 END) AS double), 6) + 0.0
       AS penetrance FROM flt GROUP BY 1) WHERE penetrance > 0.3""")),
    "penetrance_filter": (penetrance_filter, W(B.FLT + """,
pop AS (SELECT treatment, count(CASE WHEN is_non_control THEN 1 END) / CAST(count(CASE WHEN is_valid THEN 1 END) AS double) AS pen,
        count(*) AS n_cells FROM flt GROUP BY 1)""", """SELECT treatment, n_cells FROM pop
       WHERE pen > (SELECT pen FROM pop WHERE treatment = 'N')""")),
    "distance_spread": (distance_spread, W(B.FLT + """,
k AS (SELECT treatment, 'valid' AS kind, mahal_dist FROM flt WHERE is_valid
      UNION ALL SELECT treatment, 'non_control', mahal_dist FROM flt WHERE is_non_control),
km AS (SELECT treatment, kind, count(*) AS n, quantile_cont(mahal_dist, 0.5) AS med FROM k GROUP BY 1, 2)""",
       """SELECT treatment, kind, any_value(n) AS n_cells, round(any_value(med), 6) + 0.0 AS median,
       round(quantile_cont(abs(mahal_dist - med), 0.5), 6) + 0.0 AS mad
       FROM k JOIN km USING (treatment, kind) GROUP BY 1, 2""")),
    "control_mean_intensity": (control_mean_intensity, W(B.QC, """SELECT unnest(['f1','f2','f3','f4']) AS feature,
       unnest([round(avg(f1), 4) + 0.0, round(avg(f2), 4) + 0.0, round(avg(f3), 4) + 0.0, round(avg(f4), 4) + 0.0])
       AS mean_intensity FROM valid WHERE treatment = 'N'""")),
    "intensity_normalised": (intensity_normalised, W(B.QC, """SELECT object_id,
       round(f2 / (SELECT avg(f2) FROM valid WHERE treatment = 'N'), 7) + 0.0 AS f2,
       round(f3 / (SELECT avg(f3) FROM valid WHERE treatment = 'N'), 7) + 0.0 AS f3 FROM valid""")),
    "histogram": (histogram, W(B.QC + """,
mm AS (SELECT min(f2) lo, max(f2) hi FROM valid)""", """SELECT
       least(CAST(floor((f2 - lo) / ((hi - lo) / 40)) AS int), 39) AS bin, count(*) AS n FROM valid, mm GROUP BY 1""")),
    "histogram_density": (histogram_density, W(B.FLT + """,
h AS (SELECT treatment, least(CAST(floor(mahal_dist*mahal_dist / (50.0/49)) AS int), 48) AS bin, count(*) AS n
      FROM flt WHERE is_valid AND mahal_dist*mahal_dist <= 50 GROUP BY 1, 2)""", """SELECT treatment, bin, n AS n_cells,
       round(n / (sum(n) OVER (PARTITION BY treatment) * (50.0/49)), 6) + 0.0 AS density FROM h""")),
    "categorical_histogram": (categorical_histogram, W(B.CODED, """SELECT qc_code, count(*) AS n_cells,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 6) + 0.0 AS share FROM coded GROUP BY 1""")),
    "edf_steps": (edf_steps, W(B.QC, """SELECT treatment, f2, round(sum(count(*)) OVER (PARTITION BY treatment ORDER BY f2)
       / sum(count(*)) OVER (PARTITION BY treatment), 6) + 0.0 AS edf FROM valid GROUP BY 1, 2""")),
    "ddim_histogram": (ddim_histogram, W(DDIM, """SELECT group_name, b1 || ',' || b2 || ',' || b3 AS bins,
       round(density, 6) + 0.0 AS density FROM hist""")),
    "ddim_distances": (ddim_distances, W(DDIM + """,
g AS (SELECT DISTINCT group_name AS g FROM hist), b AS (SELECT DISTINCT b1, b2, b3 FROM hist),
full_hist AS (SELECT g, b.b1, b.b2, b.b3, coalesce(density, 0) AS density FROM g CROSS JOIN b
  LEFT JOIN hist h ON h.group_name = g AND h.b1 = b.b1 AND h.b2 = b.b2 AND h.b3 = b.b3),
dd AS (SELECT x.g AS group_i, y.g AS group_j, sum((x.density - y.density)*(x.density - y.density)) AS d
  FROM full_hist x JOIN full_hist y USING (b1, b2, b3) GROUP BY 1, 2)""", """SELECT group_i, group_j,
  round(d, 6) + 0.0 AS distance, round(d / (SELECT min(d) FROM dd WHERE d > 0), 6) + 0.0 AS scaled FROM dd""")),
    "dataset_statistics": (dataset_statistics, W(B.FLT, """SELECT count(*) AS n_cells,
       count(CASE WHEN is_valid THEN 1 END) AS n_valid_cells,
       count(CASE WHEN is_non_control THEN 1 END) AS n_non_control_cells,
       (SELECT count(*) FROM image_qc) AS n_images, (SELECT count(*) FROM image_qc WHERE image_code = 0) AS n_valid_images,
       (SELECT round(upper, 6) + 0.0 FROM cut) AS cutoff, (SELECT round(med, 6) + 0.0 FROM cut) AS control_median,
       (SELECT round(mad, 6) + 0.0 FROM cut) AS control_mad FROM flt""")),
    "robust_stats": (robust_stats, W(B.CELLS + """,
long AS (SELECT unnest(['f1','f2','f3','f4']) AS feature, unnest([f1, f2, f3, f4]) AS value FROM cells),
m AS (SELECT feature, count(*) AS n, quantile_cont(value, 0.5) AS med FROM long GROUP BY 1)""", """SELECT feature,
       any_value(n) AS n_cells, round(any_value(med), 4) + 0.0 AS median,
       round(quantile_cont(abs(value - med), 0.5), 4) + 0.0 AS mad FROM long JOIN m USING (feature) GROUP BY 1""")),
    "feature_box": (feature_box, W(B.QC, """SELECT unnest(['f1','f2','f3','f4']) AS feature,
       unnest([min(f1), min(f2), min(f3), min(f4)]) AS minimum, unnest([max(f1), max(f2), max(f3), max(f4)]) AS maximum
       FROM valid""")),
    "covariance": (covariance, W(B.Z, " UNION ALL ".join(
        f"SELECT 'z{i}' AS feature_i, 'z{j}' AS feature_j, round(covar_pop(z{i}, z{j}), 6) + 0.0 AS covariance FROM z"
        for i in range(1, 5) for j in range(1, 5)))),
    "label_covariances": (label_covariances, """WITH l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INT AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM l GROUP BY 1, 2),
c AS (SELECT vec_id, label, i, x - m AS y FROM l JOIN m USING (label, i))
SELECT a.label, count(*) AS n, a.i, b.i AS j, round(sum(a.y * b.y) / count(*), 8) + 0.0 AS covariance
FROM c a JOIN c b ON a.vec_id = b.vec_id GROUP BY a.label, a.i, b.i"""),
    "inverse_covariance": (inverse_covariance, W(B.Z + """,
c AS (SELECT var_pop(z1) a, var_pop(z2) b, covar_pop(z1, z2) c FROM z)""",
       """SELECT 0 AS i, 0 AS j, round(b/(a*b-c*c), 6) + 0.0 AS value FROM c
       UNION ALL SELECT 0, 1, round(-c/(a*b-c*c), 6) + 0.0 FROM c UNION ALL SELECT 1, 0, round(-c/(a*b-c*c), 6) + 0.0 FROM c
       UNION ALL SELECT 1, 1, round(a/(a*b-c*c), 6) + 0.0 FROM c""")),
    "mahalanobis_trimmed": (mahalanobis_trimmed, W(B.TRIM, """SELECT object_id,
       round(mahal_dist*mahal_dist, 6) + 0.0 AS mahal_squared FROM dist WHERE is_valid""")),
    "control_split": (control_split, W(B.FLT, """SELECT object_id, CASE WHEN is_valid THEN round(mahal_dist, 6) + 0.0
       ELSE CAST('inf' AS double) END AS mahal_dist, is_control_like, is_non_control FROM flt""")),
    "control_cutoff_median_mad": (control_cutoff_median_mad, "WITH " + _cutoff_sql(0, 1.0, False)),
    "control_cutoff_median": (control_cutoff_median, "WITH " + _cutoff_sql(1, 1.2, False)),
    "control_cutoff_median_mad_limit": (control_cutoff_median_mad_limit, "WITH " + _cutoff_sql(2, 1.0, True)),
    "control_cutoff_median_limit": (control_cutoff_median_limit, "WITH " + _cutoff_sql(3, 0.5, True)),
    "control_split_off": (control_split_off, W(
        B.QC, "SELECT is_valid AS is_non_control, count(*) AS n_cells FROM qc GROUP BY 1")),
    "whitening_matrix": (whitening_matrix, W(WHITE, """SELECT 0 AS i, 0 AS j, round(w11, 6) + 0.0 AS value FROM wm
       UNION ALL SELECT 0, 1, round(w12, 6) + 0.0 FROM wm UNION ALL SELECT 1, 0, round(w12, 6) + 0.0 FROM wm
       UNION ALL SELECT 1, 1, round(w22, 6) + 0.0 FROM wm""")),
    "transform_features": (transform_features, W(WHITE, """SELECT object_id,
       round((z1-m1)*w11 + (z2-m2)*w12, 6) + 0.0 AS w1, round((z1-m1)*w12 + (z2-m2)*w22, 6) + 0.0 AS w2 FROM z, wm""")),
    "z_score": (z_score, W(B.Z, "SELECT object_id, " + ", ".join(
        f"round(z{i}, 6) + 0.0 AS z{i}" for i in range(1, 5)) + " FROM z")),
    "z_score_bad_values": (z_score_bad_values, W(B.QC + """,
s AS (SELECT avg(f1) m1, stddev_pop(f1) s1, avg(f2) m2, stddev_pop(f2) s2 FROM valid
      WHERE treatment = 'N' AND line_no <> 7)""", """SELECT object_id, 'f1,f2' AS kept,
       round((f1-m1)/s1, 6) + 0.0 AS z1, round((f2-m2)/s2, 6) + 0.0 AS z2 FROM valid, s WHERE line_no <> 7""")),
    "feature_selection": (feature_selection, W(B.QC + """,
t AS (SELECT f1, f2, f3, f4, f3*0.1 AS f6, f2*2+f1 AS f7, f4+1000 AS f8 FROM valid)""",
       """SELECT 'nan' AS verdict, 'f5' AS feature UNION ALL
       SELECT CASE WHEN stddev_pop(f6) <= 0.01 THEN 'stddev' ELSE 'kept' END, 'f6' FROM t UNION ALL
       SELECT CASE WHEN abs(corr(f1,f2)) > 0.9 OR abs(corr(f1,f7)) > 0.9 THEN 'correlation' ELSE 'kept' END, 'f1' FROM t UNION ALL
       SELECT CASE WHEN abs(corr(f2,f7)) > 0.9 THEN 'correlation' ELSE 'kept' END, 'f2' FROM t UNION ALL
       SELECT CASE WHEN abs(corr(f3,f4)) > 0.9 THEN 'correlation' ELSE 'kept' END, 'f3' FROM t UNION ALL
       SELECT CASE WHEN abs(corr(f4,f8)) > 0.9 THEN 'correlation' ELSE 'kept' END, 'f4' FROM t UNION ALL
       SELECT 'kept', 'f7' UNION ALL SELECT 'kept', 'f8'""")),
    "pca_projection": (pca_projection, None),
    "ica_projection": (ica_projection, None),
    "robust_distance_shapes": (robust_distance_shapes, W(B.QC, """SELECT object_id,
       round(1 - exp(-pow(f2/1000.0/20, 2)), 6) + 0.0 AS gaussian, round(1 - exp(-1.5*(f2/1000.0/20)), 6) + 0.0 AS exponential,
       round(1 - 1/(exp((f2/1000.0-20)/5) + 1), 6) + 0.0 AS fermi FROM valid""")),
    "feature_importance": (feature_importance, W(
        _imp_sql("WHERE member", "feature"), _imp_select("PARTITION BY 1", "feature"))),
    "feature_weighting": (feature_weighting, W(
        _imp_sql("", "cluster, feature"), _imp_select("PARTITION BY cluster", "cluster, feature"))),
    "ks_distance": (ks_distance, W(PAIRS, """SELECT feature, round(ks, 6) + 0.0 AS ks FROM ks
       WHERE group_i = 'A' AND group_j = 'N'""")),
    "edf_distance_matrix": (edf_distance_matrix, W(PAIRS, _both_ways(
        "SELECT group_i, group_j, sqrt(sum(ks*ks)) AS d FROM ks GROUP BY 1, 2"))),
    "edf_weights": (edf_weights, W(
        PAIRS, "SELECT feature, round(mean_ks, 6) + 0.0 AS mean_ks, round(weight, 6) + 0.0 AS weight FROM kwn")),
    "weighted_edf_map": (weighted_edf_map, W(PAIRS, _both_ways(
        "SELECT group_i, group_j, sqrt(sum(ks*weight*ks*weight)) AS d FROM ks JOIN kwn USING (feature) GROUP BY 1, 2"))),
    "ks_label_pairs": (ks_label_pairs, """WITH long AS (SELECT label AS g, unnest(embedding)::DOUBLE AS value,
  unnest(range(len(embedding)))::INT AS feature FROM embeddings),
v AS (SELECT DISTINCT feature, value FROM long), gs AS (SELECT DISTINCT g FROM long),
n AS (SELECT feature, g, value, count(*) AS c FROM long GROUP BY 1, 2, 3),
f AS (SELECT v.feature, gs.g, v.value, sum(coalesce(c, 0)) OVER (PARTITION BY v.feature, gs.g ORDER BY v.value)
    / sum(coalesce(c, 0)) OVER (PARTITION BY v.feature, gs.g) AS f
  FROM v CROSS JOIN gs LEFT JOIN n ON n.feature = v.feature AND n.g = gs.g AND n.value = v.value)
SELECT a.feature, a.g AS group_i, b.g AS group_j, round(max(abs(a.f - b.f)), 6) + 0.0 AS ks
FROM f a JOIN f b ON a.feature = b.feature AND a.value = b.value AND a.g < b.g GROUP BY 1, 2, 3"""),
    "ks_p_values": (ks_p_values, W(B.FLT + """,
tc AS (SELECT mahal_dist*mahal_dist AS value, count(CASE WHEN treatment='N' THEN 1 END) n,
        count(CASE WHEN treatment='A' THEN 1 END) a, count(CASE WHEN treatment='R' THEN 1 END) r
       FROM flt WHERE is_valid GROUP BY 1),
cum AS (SELECT sum(n) OVER (ORDER BY value) / sum(n) OVER () fn, sum(a) OVER (ORDER BY value) / sum(a) OVER () fa,
        sum(r) OVER (ORDER BY value) / sum(r) OVER () fr FROM tc),
tot AS (SELECT CAST(sum(n) AS double) n, CAST(sum(a) AS double) a, CAST(sum(r) AS double) r FROM tc),
k AS (SELECT 'A' AS group_name, max(abs(fa - fn)) AS ks, any_value(sqrt(n*a/(n+a))) AS en FROM cum, tot
      UNION ALL SELECT 'R', max(abs(fr - fn)), any_value(sqrt(n*r/(n+r))) FROM cum, tot),
l AS (SELECT group_name, ks, (en + 0.12 + 0.11/en) * ks AS lam FROM k)""", """SELECT group_name, round(ks, 6) + 0.0 AS ks,
       round(CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, (SELECT sum(2 * pow(-1, j - 1) * exp(-2.0*j*j*lam*lam))
         FROM range(1, 101) t(j)))) END, 6) + 0.0 AS p_value FROM l""")),
    "bootstrap_features": (bootstrap_features, W(_bootstrap_sql(), """SELECT feature, round(ks_treated, 6) + 0.0 AS ks_treated,
       round(ks_bootstrap, 6) + 0.0 AS ks_bootstrap, round(quality, 6) + 0.0 AS quality FROM quality""")),
    "best_features": (best_features, W(_bootstrap_sql(), """SELECT * FROM (SELECT feature,
       row_number() OVER (ORDER BY quality DESC, feature) AS rank FROM quality) WHERE rank <= 2""")),
}

