"""Cluster profiles, distance maps and their validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave import fixtures as X
from cellweave.config import SplitConfig
from cellweave.functions.scalars import fraction_limit, portable_hash_sql
from cellweave.operators import grouping, masks, normalize, profiles, validation
from cellweave.queries import base as B
from cellweave.queries import cluster_base as C
from cellweave.queries.quality_q import split
from cellweave.session import cut_lineage

W, r = B.with_sql, B.r
K = 6


def _by(spark, sf, by):
    z, c, _ = C.z_model(spark, sf)
    return grouping.with_group_name(z, by), c


def _groups(spark, sf):
    return grouping.group_dimension(B.qc_cells(spark, sf), ["treatment", "replicate"])


def _long(df):
    return profiles.explode_profiles(df).select("group_name", F.col("n").alias("n_cells"), "cluster", r("value"))


def soft_profiles(spark, sf):
    rows, c = _by(spark, sf, ["treatment", "replicate"])
    return _long(profiles.soft_profiles(rows, "vec", c, groups=_groups(spark, sf)))


def smoothed_profiles(spark, sf):
    rows, c = _by(spark, sf, ["treatment", "replicate"])
    return _long(profiles.smoothed_profiles(rows, "vec", c, 10.0, groups=_groups(spark, sf)))


def unsharpened_profiles(spark, sf):
    rows, c = _by(spark, sf, ["treatment", "replicate"])
    return _long(profiles.smoothed_profiles(rows, "vec", c, 0.0, groups=_groups(spark, sf)))


def hard_profiles(spark, sf):
    rows, c = _by(spark, sf, ["treatment", "replicate"])
    return _long(profiles.hard_profiles(rows, "vec", c, groups=_groups(spark, sf)))


def normalised_profiles(spark, sf):
    rows, c = _by(spark, sf, ["well"])
    return _long(profiles.normalise_profiles(profiles.hard_profiles(rows, "vec", c), 0.4))


def _well_profiles(spark, sf):
    rows, c = _by(spark, sf, ["well"])
    return profiles.hard_profiles(rows, "vec", c), c


def _map(spark, sf, metric, threshold=0.0, made=None):
    """Map of the well profiles, or of those ``made`` before for several maps."""
    prof, c = made or _well_profiles(spark, sf)
    a = profiles.bin_similarity(c) if metric == "quadratic_chi" else None
    return profiles.distance_map(prof, metric, threshold, a, 0.5, K)


def _stored_profiles(spark, sf):
    """Well profiles that several maps start from, summed once."""
    prof, c = _well_profiles(spark, sf)
    return cut_lineage(prof), c


def _map_query(metric, threshold=0.0):
    return lambda spark, sf: _map(spark, sf, metric, threshold).select("row_group", "col_group", r("distance"))


def quadratic_chi_identity(spark, sf):
    prof, _ = _well_profiles(spark, sf)
    return profiles.distance_map(prof, "quadratic_chi", 0.0, None, 1.0, K).select("row_group", "col_group", r("distance"))


def _bins(batch):
    def run(spark, sf):
        _, c, _ = C.z_model(spark, sf)
        a = profiles.bin_similarity(c, batch=batch)
        rows = [(i, j, float(a[i, j])) for i in range(K) for j in range(K)]
        return spark.createDataFrame(rows, "cluster_i int, cluster_j int, similarity double").select(
            "cluster_i", "cluster_j", r("similarity"))
    return run


def _similarity(metric):
    return lambda spark, sf: profiles.similarity_map(_map(spark, sf, metric), metric).select(
        "row_group", "col_group", r("similarity"))


def map_quality(spark, sf):
    return profiles.map_quality(_map(spark, sf, "l1_norm")).select(r("quality"))


def profile_overlap(spark, sf):
    prof, _ = _well_profiles(spark, sf)
    return profiles.profile_overlap(prof, "[0]", "[1]").select(
        "cluster", r("overlap"), r("first_rest"), r("second_rest"))


def finite_heatmap(spark, sf):
    rows, c = _by(spark, sf, ["treatment", "replicate"])
    prof = profiles.soft_profiles(rows, "vec", c, groups=_groups(spark, sf))
    heat = profiles.distance_map(prof, "l1_norm", k=K)
    return masks.finite_groups(heat, "A,[F]").select("row_group", "col_group", r("distance"))


def treatment_comparison(spark, sf):
    heat = _map(spark, sf, "l1_norm")
    wells = B.valid_cells(spark, sf).select("well").distinct()
    near = wells.select(F.format_string("[%s]", F.col("well").cast("string")).alias("row_group"), F.explode(F.array(
        F.format_string("[%s]", (F.col("well") + 1).cast("string")),
        F.format_string("[%s]", (F.col("well") - 1).cast("string")))).alias("col_group"))
    return validation.treatment_comparison(heat, near).select(
        "row_group", r("self_distance"), r("neighbour_mean"), r("other_mean"))


# ---- splits ---------------------------------------------------------------------


def random_splits(spark, sf):
    return validation.random_split_rows(B.valid_cells(spark, sf), 3, 0.5, "seed_key", 1).groupBy(
        "split", "treatment").agg(F.count("*").alias("n_cells"))


def exact_random_split(spark, sf):
    return validation.exact_split(B.valid_cells(spark, sf), 0.3, "seed_key", "object_id", 4).select("object_id")


def _filtered_model(spark, sf):
    """Cells of the control split with z-vectors, and the fixture centroids."""
    cells = split(spark, sf).cells.filter("is_valid")
    scaling = normalize.fit_scaling(cells.filter(F.col("treatment") == X.CONTROL), X.FEATURES)
    _, c, _ = C.z_model(spark, sf)
    return cells.withColumn("vec", scaling.vector()).drop("cluster"), c


SPLITS = SplitConfig(3, 0.5, 0.25, 0.05, 1)


def random_split_distance(spark, sf):
    cells, c = _filtered_model(spark, sf)
    return validation.random_split_distances(cells, "treatment", "vec", c, "l1_norm", "seed_key", SPLITS).select(
        "treatment", "n_parts", r("distance"))


def replicate_split_distance(spark, sf):
    cells, c = _filtered_model(spark, sf)
    return validation.replicate_split_distances(cells, "treatment", "vec", c, "l1_norm", SPLITS, "plate").select(
        "treatment", "n_parts", r("distance"))


def _unfiltered(spark, sf):
    z, c, _ = C.z_model(spark, sf)
    return z.drop("cluster").withColumn("is_non_control", F.lit(True)), c


def control_comparison(spark, sf):
    cells, c = _unfiltered(spark, sf)
    return validation.control_comparison(cells, ["N", "A"], "vec", c, "l2_norm").select("n_parts", r("distance"))


FREE = SplitConfig(3, 0.5, 0.0, 0.2, 1)


def treatment_map(spark, sf):
    cells, c = _unfiltered(spark, sf)
    prof = profiles.soft_profiles(cells.withColumn("group_name", F.col("treatment")), "vec", c)
    heat = profiles.distance_map(prof, "l1_norm", k=K)
    rnd = validation.random_split_distances(cells, "treatment", "vec", c, "l1_norm", "seed_key", FREE)
    rep = cut_lineage(validation.replicate_split_distances(cells, "treatment", "vec", c, "l1_norm", FREE, "plate"))
    limit = rep.agg(F.avg("distance")).first()[0]
    return validation.treatment_map(heat, rnd, rep, "treatment", limit).select(
        "row_group", "col_group", r("distance"), "is_flagged")


def combined_map(spark, sf):
    made = _stored_profiles(spark, sf)
    return validation.combine_maps(_map(spark, sf, "l1_norm", made=made).union(_map(spark, sf, "l1_norm", 0.4, made))).select(
        "row_group", "col_group", r("distance"))


def _runs(spark, sf):
    """Diagonal entries of random and plate split maps for two numbers of clusters."""
    out, scored = None, B.z_cells(spark, sf)
    for k, label in ((6, C.LABEL), (3, C.COARSE)):
        z, c, _ = C.z_model(spark, sf, label, k, scored)
        cells = z.drop("cluster").withColumn("is_non_control", F.lit(True))
        parts = [
            validation.random_split_distances(cells, "treatment", "vec", c, "l1_norm", "seed_key",
                                              SplitConfig(2, 0.5, 0.0, 1.0, 1)).withColumn("kind", F.lit("random")),
            validation.replicate_split_distances(cells, "treatment", "vec", c, "l1_norm", FREE, "plate").withColumn(
                "kind", F.lit("replicate"))]
        for part in parts:
            rows = part.select("kind", F.lit(k).alias("param1"), F.col("treatment").alias("label"),
                               F.col("distance").alias("value"))
            out = rows if out is None else out.union(rows)
    return out


def diagonal_statistics(spark, sf):
    return validation.diagonal_statistics(_runs(spark, sf)).select("kind", "label", r("mean_value"), r("std_value"))


def diagonal_by_clusters(spark, sf):
    return validation.diagonal_by_clusters(_runs(spark, sf)).select(
        "kind", "param1", "label", r("mean_value"), r("std_value"))


def _curve(spark, sf):
    out, made = None, _stored_profiles(spark, sf)
    for metric in ("l1_norm", "l2_norm"):
        for t in (0, 20, 40):
            q = profiles.map_quality(_map(spark, sf, metric, t / 100, made)).select(
                F.lit(metric).alias("metric"), F.lit(t).alias("param1"), r("quality"))
            out = q if out is None else out.union(q)
    return out


def quality_curve(spark, sf):
    return _curve(spark, sf)


def best_quality(spark, sf):
    return validation.best_quality(_curve(spark, sf))


# ---- duplicates -------------------------------------------------------------------


def duplicate_at_random(spark, sf):
    return validation.duplicate_at_random(B.valid_cells(spark, sf), "seed_key").select("object_id", "treatment")


def duplicate_by_replicate(spark, sf):
    images = X.images(spark, sf).withColumn("path", F.concat(
        F.lit("screen/"), F.col("priority"), F.lit("/"), F.col("image_id").cast("string"), F.lit(".tif")))
    images = images.withColumn("directory", validation.replicate_directory(F.col("path")))
    return validation.duplicate_by_replicate(images, "directory").groupBy("treatment", "directory").agg(
        F.count("*").alias("n_images"))


def _half_map(spark, sf):
    z, c, _ = C.z_model(spark, sf)
    dup = validation.duplicate_at_random(z.select("object_id", "seed_key", "treatment", "vec"), "seed_key")
    prof = profiles.hard_profiles(dup.withColumn("group_name", F.col("treatment")), "vec", c)
    return profiles.distance_map(prof, "l1_norm", k=K)


def split_pair_statistics(spark, sf):
    out = validation.split_pair_statistics(_half_map(spark, sf))
    return out.select("label", *[r(c) for c in out.columns if c != "label"])


def modified_similarity(spark, sf):
    return validation.modified_similarity(_half_map(spark, sf)).select("row_base", "col_base", r("similarity"))


def heatmap_threshold(spark, sf):
    return validation.heatmap_threshold(_half_map(spark, sf)).select(r("threshold"))


# ---- SQL ----------------------------------------------------------------------------

DIMS = """,
dims AS (SELECT t.treatment || ',[' || r.replicate || ']' AS group_name FROM (SELECT DISTINCT treatment FROM qc) t
  CROSS JOIN (SELECT DISTINCT replicate FROM qc) r),
ids AS (SELECT group_name, CAST(c AS int) AS cluster FROM dims CROSS JOIN range(6) t(c))"""
GROUP = "treatment || ',[' || replicate || ']'"
DELTA = f"""(SELECT min({C.d_sql('a.c', 'b.c')}) FROM cent a JOIN cent b ON a.cluster <> b.cluster)"""


def soft_sql(group: str, source: str = "cd", name: str = "soft") -> str:
    return f"""
delta AS MATERIALIZED (SELECT {DELTA} AS delta),
{name}_m AS (SELECT object_id, {group} AS group_name, cluster, exp(-d/delta) / sum(exp(-d/delta)) OVER (PARTITION BY object_id, {group}) AS m
  FROM {source}, delta),
{name} AS (SELECT group_name, cluster, avg(m) AS value, count(*) AS n FROM {name}_m GROUP BY 1, 2)"""


def _with_empty(name: str, filler: str) -> str:
    return f"""SELECT ids.group_name, coalesce(n, 0) AS n_cells, ids.cluster,
  round(CASE WHEN n IS NULL THEN {filler} ELSE coalesce(value, 0) END, 6) + 0.0 AS value
  FROM ids LEFT JOIN (SELECT group_name AS gn, any_value(n) AS n FROM {name} GROUP BY 1) s ON gn = ids.group_name
  LEFT JOIN (SELECT group_name, cluster, value FROM {name}) v ON v.group_name = ids.group_name AND v.cluster = ids.cluster"""


def smooth_sql(factor: float) -> str:
    sharpen = "s" if factor == 0 else (
        f"(exp({factor} * s / max(s) OVER (PARTITION BY group_name)) - 1) / (exp({factor}) - 1)")
    return f"""
sm0 AS (SELECT object_id, {GROUP} AS group_name, cluster, CASE WHEN min(d) OVER (PARTITION BY object_id) = 0
   THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / d END AS s FROM cd),
sm1 AS (SELECT object_id, group_name, cluster, {sharpen} AS s FROM sm0),
sm2 AS (SELECT object_id, group_name, cluster, s / sum(s) OVER (PARTITION BY object_id) AS m FROM sm1),
smooth AS (SELECT group_name, cluster, sum(m) AS value, count(*) AS n FROM sm2 GROUP BY 1, 2)"""


HARD = """
hard AS (SELECT {group} AS group_name, cluster, CAST(count(*) AS double) AS value,
  CAST(sum(count(*)) OVER (PARTITION BY {group}) AS bigint) AS n FROM asg GROUP BY {group}, cluster)"""

# normalised profiles of all wells, every cluster present
WELLS = C.MODEL + "," + HARD.format(group="'[' || well || ']'") + """,
wp AS (SELECT g.group_name, CAST(c AS int) AS cluster, coalesce(value, 0.0) AS v
  FROM (SELECT DISTINCT group_name FROM hard) g CROSS JOIN range(6) t(c)
  LEFT JOIN hard h ON h.group_name = g.group_name AND h.cluster = c),
np AS (SELECT group_name, cluster, v / sum(v) OVER (PARTITION BY group_name) AS p FROM wp),
tp AS (SELECT group_name, cluster, t / sum(t) OVER (PARTITION BY group_name) AS p FROM (
  SELECT *, CASE WHEN v < 0.4 * max(v) OVER (PARTITION BY group_name) THEN 0 ELSE v END AS t FROM wp))"""


def heat_sql(metric: str, source: str = "np", keys: str = "") -> str:
    """(row_group, col_group, distance) over a normalised long profile."""
    expr = {
        "summed_minmax": "1 - sum(pow(least(x.p, y.p), 2)) / sum(pow(greatest(x.p, y.p), 2))",
        "l2_norm": "sqrt(sum(pow(x.p - y.p, 2)))",
        "l1_norm": "sum(abs(x.p - y.p))",
        "summed_difference": "sum(abs(x.p - y.p))",
        "chi1_norm": "sum(CASE WHEN x.p = 0 AND y.p = 0 THEN 0 ELSE abs(x.p - y.p) / (x.p + y.p) END)",
        "chi2_norm": "sum(CASE WHEN x.p = 0 AND y.p = 0 THEN 0 ELSE pow(x.p - y.p, 2) / (x.p + y.p) END)",
    }[metric]
    k = f"x.{keys} AS {keys}, " if keys else ""
    on = f" AND x.{keys} = y.{keys}" if keys else ""
    return (f"SELECT {k}x.group_name AS row_group, y.group_name AS col_group,"
            f" CASE WHEN x.group_name = y.group_name THEN 0.0 ELSE {expr} END AS distance"
            f" FROM {source} x JOIN {source} y ON x.cluster = y.cluster{on} GROUP BY ALL").replace(
        "GROUP BY ALL", "GROUP BY " + (f"x.{keys}, " if keys else "") + "x.group_name, y.group_name")


def quad_sql(m: float, identity: bool) -> str:
    a = "CASE WHEN i = j THEN 1.0 ELSE 0.0 END" if identity else "a"
    return WELLS + f""",
sim AS (SELECT a.cluster AS i, b.cluster AS j, exp(-{C.d_sql('a.c', 'b.c')} / {DELTA}) AS a FROM cent a CROSS JOIN cent b),
am AS MATERIALIZED (SELECT i, j, {a} AS a FROM sim),
pq AS (SELECT x.group_name AS rg, y.group_name AS cg, x.cluster, x.p, y.p AS q FROM np x JOIN np y USING (cluster)),
dk AS (SELECT rg, cg, j AS cluster, sum(pow((p + q) * a, {m})) AS dd FROM pq JOIN am ON i = cluster GROUP BY 1, 2, 3),
zk AS (SELECT rg, cg, cluster, CASE WHEN dd = 0 THEN 0 ELSE (p - q) / dd END AS z FROM pq JOIN dk USING (rg, cg, cluster)),
quad AS (SELECT x.rg AS row_group, x.cg AS col_group, CASE WHEN x.rg = x.cg THEN 0.0 ELSE sum(x.z * y.z * a) END AS distance
  FROM zk x JOIN zk y ON x.rg = y.rg AND x.cg = y.cg JOIN am ON i = x.cluster AND j = y.cluster GROUP BY x.rg, x.cg)"""


OUT = "SELECT row_group, col_group, round(distance, 6) + 0.0 AS distance FROM "


def _similarity_sql(metric: str) -> str:
    if metric == "summed_minmax":
        return W(WELLS, f"SELECT row_group, col_group, round(1 - distance, 6) + 0.0 AS similarity FROM ({heat_sql(metric)})")
    return W(WELLS + f", heat AS ({heat_sql(metric)})", """SELECT row_group, col_group,
       round(1 - distance / (SELECT max(distance) FROM heat), 6) + 0.0 AS similarity FROM heat""")


def split_hits(n: int, fraction: float, seed: int, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT *, {i} AS part FROM {source} WHERE {portable_hash_sql('seed_key', seed + i)} < {fraction_limit(fraction)}"
        for i in range(n))


def parts_sql(tag: str, member_sql: str, group: str = "treatment") -> str:
    """Soft profiles of (group, part) rows of ``member_sql`` (cd columns plus part) and their mean distance."""
    return f"""
{tag}_mem AS ({member_sql}),
{tag}_m AS (SELECT object_id, {group} AS grp, CAST(part AS varchar) AS group_name, cluster,
   exp(-d/delta) / sum(exp(-d/delta)) OVER (PARTITION BY object_id, {group}, part) AS m FROM {tag}_mem, delta),
{tag}_p AS (SELECT grp, group_name, cluster, avg(m) AS p FROM {tag}_m GROUP BY 1, 2, 3),
{tag}_h AS ({heat_sql('l1_norm', tag + '_p', 'grp')}),
{tag} AS (SELECT grp, (SELECT count(DISTINCT group_name) FROM {tag}_p q WHERE q.grp = h.grp) AS n_parts,
   avg(distance) AS distance FROM {tag}_h h WHERE row_group <> col_group GROUP BY grp)"""


DELTA_CTE = f"delta AS MATERIALIZED (SELECT {DELTA} AS delta)"

# control split plus clustering fixture
FLTZ = B.FLT + """,
scaling AS (
  SELECT avg(f1) m1, stddev_pop(f1) s1, avg(f2) m2, stddev_pop(f2) s2,
         avg(f3) m3, stddev_pop(f3) s3, avg(f4) m4, stddev_pop(f4) s4
  FROM valid WHERE treatment = 'N'),
z AS (SELECT v.*, (f1-m1)/s1 AS z1, (f2-m2)/s2 AS z2, (f3-m3)/s3 AS z3, (f4-m4)/s4 AS z4 FROM flt v, scaling WHERE is_valid)"""
ELIGIBLE = """
elig AS (SELECT treatment FROM z GROUP BY 1 HAVING count(CASE WHEN is_non_control THEN 1 END) >= 2
  AND count(CASE WHEN is_non_control THEN 1 END) / CAST(count(*) AS double) >= 0.25),
ec AS (SELECT * FROM cd WHERE is_non_control AND treatment IN (SELECT treatment FROM elig))"""


def _runs_sql() -> str:
    out, unions = B.Z, []
    for k, label in ((6, C.LABEL), (3, C.COARSE)):
        out += f""",
cent{k} AS (SELECT {label} AS cluster, avg(z1) c1, avg(z2) c2, avg(z3) c3, avg(z4) c4 FROM z GROUP BY 1),
delta{k} AS MATERIALIZED (SELECT min({C.d_sql('a.c', 'b.c')}) AS delta FROM cent{k} a JOIN cent{k} b ON a.cluster <> b.cluster),
cd{k} AS (SELECT z.*, cluster, {C.d_sql('z', 'c')} AS d FROM z CROSS JOIN cent{k}),"""
        out += parts_sql(f"rnd{k}", split_hits(2, 0.5, 1, f"cd{k}")).replace(", delta)", f", delta{k})")
        out += "," + parts_sql(f"rep{k}", f"SELECT *, plate AS part FROM cd{k}").replace(", delta)", f", delta{k})")
        unions += [f"SELECT 'random' AS kind, {k} AS param1, grp AS label, distance AS value FROM rnd{k}",
                   f"SELECT 'replicate', {k}, grp, distance FROM rep{k}"]
    return out + ",\nruns AS (" + " UNION ALL ".join(unions) + ")"


def _curve_sql() -> str:
    ctes, unions = WELLS, []
    for t in (20, 40):
        ctes += f""",
tp{t} AS (SELECT group_name, cluster, t / sum(t) OVER (PARTITION BY group_name) AS p FROM (
  SELECT *, CASE WHEN v < {t / 100} * max(v) OVER (PARTITION BY group_name) THEN 0 ELSE v END AS t FROM wp))"""
    for metric in ("l1_norm", "l2_norm"):
        for t, src in ((0, "np"), (20, "tp20"), (40, "tp40")):
            unions.append(f"""SELECT '{metric}' AS metric, {t} AS param1,
  round(avg(distance) FILTER (row_group <> col_group) - avg(distance) FILTER (row_group = col_group), 6) + 0.0 AS quality
  FROM ({heat_sql(metric, src)})""")
    return ctes + ",\ncurve AS (" + " UNION ALL ".join(unions) + ")"


DUP = f"""
dup AS (SELECT object_id, CASE WHEN rn <= n - n // 2 THEN treatment ELSE treatment || '*' END AS treatment FROM (
  SELECT object_id, treatment, row_number() OVER (PARTITION BY treatment ORDER BY {portable_hash_sql('seed_key', 3)}, object_id) AS rn,
         count(*) OVER (PARTITION BY treatment) AS n FROM valid))"""
HALVES = C.MODEL + "," + DUP + """,
hp AS (SELECT g.group_name, CAST(c AS int) AS cluster, coalesce(v, 0.0) AS v FROM (SELECT DISTINCT treatment AS group_name FROM dup) g
  CROSS JOIN range(6) t(c) LEFT JOIN (SELECT dup.treatment AS group_name, cluster, CAST(count(*) AS double) AS v
    FROM asg JOIN dup USING (object_id) GROUP BY 1, 2) h ON h.group_name = g.group_name AND h.cluster = c),
hn AS (SELECT group_name, cluster, v / sum(v) OVER (PARTITION BY group_name) AS p FROM hp),
heat AS (""" + heat_sql("l1_norm", "hn") + """),
hb AS (SELECT *, rtrim(row_group, '*') AS rb, rtrim(col_group, '*') AS cb FROM heat),
own AS (SELECT rb AS label, distance AS self_match FROM hb WHERE rb = cb AND row_group < col_group)"""

QUERIES = {
    "soft_profiles": (soft_profiles, W(
        C.MODEL + DIMS + "," + soft_sql(GROUP), _with_empty("soft", "CAST('nan' AS double)"))),
    "smoothed_profiles": (smoothed_profiles, W(C.MODEL + DIMS + "," + smooth_sql(10.0), _with_empty("smooth", "0.0"))),
    "unsharpened_profiles": (unsharpened_profiles, W(C.MODEL + DIMS + "," + smooth_sql(0), _with_empty("smooth", "0.0"))),
    "hard_profiles": (hard_profiles, W(C.MODEL + DIMS + "," + HARD.format(group=GROUP), _with_empty("hard", "0.0"))),
    "normalised_profiles": (normalised_profiles, W(WELLS, """SELECT tp.group_name, n AS n_cells, tp.cluster,
       round(p, 6) + 0.0 AS value FROM tp JOIN (SELECT group_name, any_value(n) AS n FROM hard GROUP BY 1) h USING (group_name)""")),
    **{f"distance_map_{m}": (_map_query(m), W(WELLS, f"{OUT} ({heat_sql(m)})"))
       for m in profiles.METRICS if m != "quadratic_chi"},
    "distance_map_thresholded": (_map_query("l1_norm", 0.4), W(WELLS, f"{OUT} ({heat_sql('l1_norm', 'tp')})")),
    "distance_map_quadratic_chi": (_map_query("quadratic_chi"), W(quad_sql(0.5, False), OUT + "quad")),
    "distance_map_quadratic_chi_identity": (quadratic_chi_identity, W(quad_sql(1.0, True), OUT + "quad")),
    "bin_similarity": (_bins(False), W(C.MODEL, f"""SELECT a.cluster AS cluster_i, b.cluster AS cluster_j,
       round(exp(-{C.d_sql('a.c', 'b.c')} / {DELTA}), 6) + 0.0 AS similarity FROM cent a CROSS JOIN cent b""")),
    "bin_similarity_batch": (_bins(True), W(C.MODEL, f"""SELECT a.cluster AS cluster_i, b.cluster AS cluster_j,
       round(exp(-{C.d_sql('a.c', 'b.c')}), 6) + 0.0 AS similarity FROM cent a CROSS JOIN cent b""")),
    **{f"similarity_map_{m}": (_similarity(m), _similarity_sql(m)) for m in ("summed_minmax", "l2_norm", "chi2_norm")},
    "map_quality": (map_quality, W(WELLS, f"""SELECT round(avg(distance) FILTER (row_group <> col_group)
       - avg(distance) FILTER (row_group = col_group), 6) + 0.0 AS quality FROM ({heat_sql('l1_norm')})""")),
    "profile_overlap": (profile_overlap, W(WELLS, """SELECT x.cluster, round(least(x.p, y.p), 6) + 0.0 AS overlap,
       round(x.p - least(x.p, y.p), 6) + 0.0 AS first_rest, round(y.p - least(x.p, y.p), 6) + 0.0 AS second_rest
       FROM np x JOIN np y USING (cluster) WHERE x.group_name = '[0]' AND y.group_name = '[1]'""")),
    "finite_heatmap": (finite_heatmap, W(C.MODEL + "," + soft_sql(GROUP) + """,
sn AS (SELECT group_name, cluster, value AS p FROM soft)""", f"{OUT} ({heat_sql('l1_norm', 'sn')})")),
    "treatment_comparison": (treatment_comparison, W(WELLS + f""",
heat AS ({heat_sql('l1_norm')}),
hh AS (SELECT *, CAST(replace(replace(row_group, '[', ''), ']', '') AS int) AS a,
  CAST(replace(replace(col_group, '[', ''), ']', '') AS int) AS b FROM heat)""", """SELECT row_group,
  round(max(CASE WHEN a = b THEN distance END), 6) + 0.0 AS self_distance,
  round(avg(CASE WHEN abs(a - b) = 1 THEN distance END), 6) + 0.0 AS neighbour_mean,
  round(avg(CASE WHEN abs(a - b) > 1 THEN distance END), 6) + 0.0 AS other_mean FROM hh GROUP BY 1""")),
    "random_splits": (random_splits, W(B.QC, f"""SELECT part AS split, treatment, count(*) AS n_cells
       FROM ({split_hits(3, 0.5, 1, 'valid')}) GROUP BY 1, 2""")),
    "exact_random_split": (exact_random_split, W(B.QC, f"""SELECT object_id FROM (SELECT object_id,
       row_number() OVER (ORDER BY {portable_hash_sql('seed_key', 4)}, object_id) AS rn, count(*) OVER () AS n FROM valid)
       WHERE rn <= round_even(n * 0.3, 0)""")),
    "random_split_distance": (random_split_distance, W(
        C.model_sql(FLTZ) + "," + ELIGIBLE + "," + DELTA_CTE + "," + parts_sql("rnd", split_hits(3, 0.5, 1, "ec")),
        "SELECT grp AS treatment, n_parts, round(distance, 6) + 0.0 AS distance FROM rnd WHERE n_parts >= 2")),
    "replicate_split_distance": (replicate_split_distance, W(
        C.model_sql(FLTZ) + "," + ELIGIBLE + "," + DELTA_CTE + "," + parts_sql("rep", "SELECT *, plate AS part FROM ec"),
        "SELECT grp AS treatment, n_parts, round(distance, 6) + 0.0 AS distance FROM rep WHERE n_parts >= 2")),
    "control_comparison": (control_comparison, W(
        C.MODEL + "," + soft_sql("treatment || '_' || replicate") + """,
cn AS (SELECT group_name, cluster, value AS p FROM soft WHERE left(group_name, 1) IN ('N', 'A'))""", f"""SELECT
       (SELECT count(DISTINCT group_name) FROM cn) AS n_parts, round(avg(distance), 6) + 0.0 AS distance
       FROM ({heat_sql('l2_norm', 'cn')}) WHERE row_group <> col_group""")),
    "treatment_map": (treatment_map, W(
        C.MODEL + "," + soft_sql("treatment") + ", sn AS (SELECT group_name, cluster, value AS p FROM soft), heat AS ("
        + heat_sql("l1_norm", "sn") + ")," + parts_sql("rnd", split_hits(3, 0.5, 1, "cd")) + ","
        + parts_sql("rep", "SELECT *, plate AS part FROM cd")
        + ", bad AS (SELECT grp FROM rep WHERE distance > (SELECT avg(distance) FROM rep))",
        """SELECT row_group, col_group, round(CASE WHEN row_group = col_group THEN
       (SELECT distance FROM rnd WHERE grp = row_group) ELSE distance END, 6) + 0.0 AS distance,
       (row_group IN (SELECT grp FROM bad) OR col_group IN (SELECT grp FROM bad)) AS is_flagged FROM heat""")),
    "combined_map": (combined_map, W(WELLS, f"""SELECT row_group, col_group, round(avg(distance), 6) + 0.0 AS distance FROM (
       {heat_sql('l1_norm')} UNION ALL {heat_sql('l1_norm', 'tp')}) GROUP BY 1, 2""")),
    "diagonal_statistics": (diagonal_statistics, W(_runs_sql(), """SELECT kind, label, round(avg(value), 6) + 0.0 AS mean_value,
       round(stddev_pop(value), 6) + 0.0 AS std_value FROM runs GROUP BY 1, 2""")),
    "diagonal_by_clusters": (diagonal_by_clusters, W(_runs_sql(), """SELECT kind, param1, coalesce(label, '*') AS label,
       round(avg(value), 6) + 0.0 AS mean_value, round(stddev_pop(value), 6) + 0.0 AS std_value
       FROM runs GROUP BY GROUPING SETS ((kind, param1, label), (kind, param1))""")),
    "quality_curve": (quality_curve, W(_curve_sql(), "SELECT metric, param1, quality FROM curve")),
    "best_quality": (best_quality, W(_curve_sql(), """SELECT metric, param1, quality FROM (SELECT *, row_number() OVER (
       PARTITION BY metric ORDER BY quality DESC, param1) AS rn FROM curve) WHERE rn = 1""")),
    "duplicate_at_random": (duplicate_at_random, W(B.QC + "," + DUP, "SELECT object_id, treatment FROM dup")),
    "duplicate_by_replicate": (duplicate_by_replicate, """WITH d AS (SELECT o_orderstatus AS treatment,
       'screen/' || o_orderpriority AS directory, count(*) AS n_images FROM orders GROUP BY 1, 2)
       SELECT treatment || CASE WHEN row_number() OVER w <= ceil(count(*) OVER (PARTITION BY treatment) / 2.0) THEN '' ELSE '*' END
       AS treatment, directory, n_images FROM d WINDOW w AS (PARTITION BY treatment ORDER BY directory)"""),
    "split_pair_statistics": (split_pair_statistics, W(HALVES, """SELECT label, round(self_match, 6) + 0.0 AS self_match,
       round(quantile_cont(distance, 0.5), 6) + 0.0 AS median_others, round(avg(distance), 6) + 0.0 AS mean_others,
       round(min(distance), 6) + 0.0 AS min_others, round(max(distance), 6) + 0.0 AS max_others,
       round(min(distance) - self_match, 6) + 0.0 AS min_minus_self, round(self_match - max(distance), 6) + 0.0 AS self_minus_max
       FROM own JOIN hb ON rb = label AND cb <> label GROUP BY label, self_match""")),
    "modified_similarity": (modified_similarity, W(HALVES + """,
fb AS (SELECT rb, cb, CASE WHEN row_group = col_group THEN o.self_match ELSE distance END AS distance, o.self_match AS sa, p.self_match AS sb
  FROM hb JOIN own o ON o.label = rb JOIN own p ON p.label = cb)""", """SELECT rb AS row_base, cb AS col_base,
  round(avg(distance) * any_value(CASE WHEN greatest(sa, sb) = 0 THEN 1 ELSE least(sa, sb) / greatest(sa, sb) END), 6) + 0.0
  AS similarity FROM fb GROUP BY 1, 2""")),
    "heatmap_threshold": (heatmap_threshold, W(HALVES, "SELECT round(2 * max(self_match), 6) + 0.0 AS threshold FROM own")),
}
