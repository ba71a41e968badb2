"""Sources, sinks, streaming, classifiers and whole stages."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv as pa_csv
from pyspark.sql import functions as F

from cellweave import fixtures as X
from cellweave.config import ClusterConfig, FilterConfig, ProfileConfig, SplitConfig, SweepConfig
from cellweave.operators import classify, linkage, normalize
from cellweave.plans import stages, sweep
from cellweave.queries import base as B
from cellweave.queries import cluster_base as C
from cellweave.queries.profile_q import FLTZ, WELLS, _map, heat_sql, split_hits
from cellweave.queries.quality_q import split
from cellweave.session import scratch_path
from cellweave.sources import csv_sets, database, dataset, exports
from cellweave.streaming import jobs

W, r = B.with_sql, B.r


# ---- CSV sets -------------------------------------------------------------------


def write_csv_sets(spark, sf, path):
    """One set per supplier: an image file and two object files; every tenth supplier lacks one.

    Tasks write into the folder all executors share.
    """
    cells = X.cells(spark, sf).select("supplier_id", "object_id", "treatment", "f1", "f2", "f3", "f4")
    root = path.removeprefix("file:")

    def put(part: pa.Table, name: str, columns: dict[str, str]) -> None:
        """Columns under new names; a NaN is written like a null."""
        out = {}
        for source, target in columns.items():
            c = part.column(source)
            out[target] = pc.if_else(pc.is_nan(c), None, c) if pa.types.is_floating(c.type) else c
        pa_csv.write_csv(pa.table(out), name, pa_csv.WriteOptions(quoting_style="needed"))

    def write(part: pa.Table) -> pa.Table:
        s = part.column("supplier_id")[0].as_py()
        os.makedirs(root, exist_ok=True)
        part = part.sort_by("object_id")
        base = f"{root}/s{s:07d}"
        with open(f"{base}_Image.csv", "w", encoding="utf-8") as f:
            f.write(f"ImageNumber,FileName_DAPI,PathName_DAPI,Metadata_Well\n{s},{s}.tif,img/dapi,W{s % 12}\n")
        put(part, f"{base}_Nuclei.csv", {"f1": "f1", "f2": "f2", "treatment": "treatment"})
        if s % 10:
            put(part, f"{base}_Cells.csv", {"f3": "Cells_f3", "f4": "f4"})
        return pa.table({"n": pa.array([part.num_rows], pa.int64())})

    cells.groupBy("supplier_id").applyInArrow(write, "n bigint").agg(F.sum("n")).collect()


def _import(spark, sf):
    path = scratch_path(spark, "csv")
    write_csv_sets(spark, sf, path)
    return csv_sets.import_csv(spark, path, "_Image", ["_Nuclei", "_Cells"], id_columns=["Metadata_Well"])


def csv_import(spark, sf):
    t = _import(spark, sf)
    images = t["images"].select("base", F.col("ImageNumber").cast("bigint").alias("image_no"), "Metadata_Well",
                                F.col("image_files")[0]["path"].alias("file"))
    return t["objects"].join(images, "base").groupBy("image_no", "Metadata_Well", "file").agg(
        F.count("*").alias("n_objects"), r(F.sum("Nuclei_f2"), 2, "sum_f2"), r(F.sum("Cells_f3"), 4, "sum_f3"))


def csv_incomplete_sets(spark, sf):
    t = _import(spark, sf)
    return t["incomplete"].select(
        F.regexp_extract("base", r"s(\d+)$", 1).cast("bigint").alias("image_no"), "kind")


def _text_rows(spark, sf):
    c = X.cells(spark, sf)
    code = F.when(F.col("line_no") == 7, F.lit("n/a")).otherwise(F.col("f3").cast("string"))
    return c.select("object_id", F.create_map(
        F.lit("f1"), F.col("f1").cast("string"), F.lit("f3"), code, F.lit("treatment"), F.col("treatment"),
        F.lit("well"), F.col("well").cast("string")).alias("values"))


def csv_type_inference(spark, sf):
    types = csv_sets.infer_types(_text_rows(spark, sf), ["f1", "f3", "treatment", "well"], ["well"])
    return spark.createDataFrame(list(types.items()), "column_name string, column_type string")


def image_file_list(spark, sf):
    o = X.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".tif")).alias("FileName_DAPI"),
        F.col("o_orderpriority").alias("PathName_DAPI"), F.col("o_orderstatus").alias("FileName_GFP"))
    files = csv_sets.image_files(o.columns)
    return o.select("image_id", F.explode(files).alias("f")).select("image_id", "f.entity", "f.path")


def dimension_encoding(spark, sf):
    """Treatments numbered by first appearance in image order, inherited by every object."""
    df, _ = csv_sets.encode_dimension(X.cells(spark, sf), "treatment", ["image_id", "object_id"], "treatment")
    df, _ = csv_sets.encode_dimension(df, "well", ["image_id", "object_id"], "well")
    return df.groupBy("treatment_name", "treatment_index", "well_name", "well_index").agg(
        F.count("*").alias("n_cells"))


def virtual_ids(spark, sf):
    cells = X.cells(spark, sf).drop("plate")
    out = csv_sets.add_virtual_ids(cells, {
        "plate": F.lit(0).cast("bigint"), "quality_control": F.lit(0), "image_id": F.lit(-1)})
    return out.groupBy("plate", "quality_control").agg(
        F.count("*").alias("n_cells"), F.count_distinct("image_id").alias("n_images"))


# ---- database and datasets --------------------------------------------------------


def database_selection(spark, sf):
    images = database.select_images(
        X.images(spark, sf), {"treatment": ["F", "P"], "priority": ["1-URGENT", "2-HIGH"]}, ["image_id", "treatment"])
    objects = database.objects_of(X.cells(spark, sf), images, columns=["object_id", "f1", "f2"])
    return objects.select("image_id", "object_id", "f1", "f2")


def treatment_filter_file(spark, sf):
    path = scratch_path(spark, "names")
    X.table(spark, sf, "part").filter("p_size > 45").select(
        F.concat(F.lit("  "), F.col("p_brand"), F.lit(" ")).alias("value")).union(
        spark.range(1).select(F.lit("").alias("value"))).write.text(path)
    names = database.read_name_list(spark, path)
    return database.filter_treatments(X.table(spark, sf, "part"), names, "p_brand").groupBy("p_brand").agg(
        F.count("*").alias("n_parts"))


def dataset_roundtrip(spark, sf):
    path = scratch_path(spark, "dataset")
    dataset.save_dataset({"objects": B.qc_cells(spark, sf), "images": X.images(spark, sf)}, path, X.FEATURES)
    tables, features = dataset.load_dataset(spark, path)
    return tables["objects"].groupBy("treatment", "is_valid").agg(
        F.count("*").alias("n_cells"), r(F.sum(features[0]), 2, "sum_f1")).withColumn("n_features", F.lit(len(features)))


def dataset_merge(spark, sf):
    cells = X.cells(spark, sf)
    a = cells.filter("image_id % 2 = 0").select("object_id", "treatment", "replicate", "well", "f1", "f2").withColumn(
        "treatment", F.when(F.col("treatment") == "N", F.lit("wt1")).otherwise(F.col("treatment")))
    b = cells.filter("image_id % 2 = 1").select("f2", "well", "f1", "object_id", "f3", "replicate", "treatment").withColumns({
        "treatment": F.when(F.col("treatment") == "N", F.lit("mock1")).otherwise(F.col("treatment")),
        "replicate": F.when(F.col("replicate") == "O", F.lit("")).otherwise(F.col("replicate"))})
    merged, _ = dataset.merge_datasets([a, b], ["f1", "f2"])
    return merged.groupBy("treatment", "treatment_index", "replicate", "replicate_index").agg(
        F.count("*").alias("n_cells"), r(F.sum("f1"), 2, "sum_f1"))


def _saved_model(spark, sf):
    z, c, n = C.z_model(spark, sf)
    scaling = normalize.fit_scaling(B.valid_cells(spark, sf).filter(F.col("treatment") == X.CONTROL), X.FEATURES)
    path = scratch_path(spark, "model")
    dataset.save_model(spark, path, c, scaling, {"method": "k-means"}, n)
    return path


def model_scoring(spark, sf):
    """Clusters saved, loaded and applied to every valid cell."""
    c, scaling, _ = dataset.load_model(spark, _saved_model(spark, sf))
    return stages.score_cells(B.valid_cells(spark, sf), scaling, c).select(
        "object_id", F.col("cluster").alias("ClusterID"), r(F.array_min("dist"), 6, "distance"))


def state_roundtrip(spark, sf):
    path = scratch_path(spark, "state")
    dataset.save_state({"quality_control": B.qc_cells(spark, sf)}, path)
    return dataset.load_state(spark, path, "quality_control").groupBy("qc_code", "image_code").agg(
        F.count("*").alias("n_cells"))


def heatmap_export(spark, sf):
    labels = [f"[{i}]" for i in range(12)]
    path = scratch_path(spark, "heatmap")
    exports.write_heatmap(_map(spark, sf, "l1_norm"), path, "l1 distances", labels)
    return spark.read.text(path).select(F.col("value").alias("line"))


def feature_export(spark, sf):
    path = scratch_path(spark, "features")
    exports.write_features(B.valid_cells(spark, sf), path, "object_id", ["f1", "f3"])
    return spark.read.text([f"{path}/header", f"{path}/rows"]).select(F.col("value").alias("line"))


# ---- streaming --------------------------------------------------------------------


def _stream(spark, sf, name):
    """File-stream source over one table."""
    schema = X.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _stream_cells(spark, sf):
    s = _stream(spark, sf, "lineitem")
    return s.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("treatment"), F.col("l_quantity").alias("f1"),
                    F.col("l_extendedprice").alias("f2"), F.col("l_discount").alias("f3"), F.col("l_tax").alias("f4"))


def _drain(spark, stream, name, mode="append"):
    path = scratch_path(spark, name)
    jobs.drain_to_parquet(stream, path, scratch_path(spark, name + "-checkpoint"), mode)
    return spark.read.parquet(path)


def stream_quality(spark, sf):
    out = _drain(spark, jobs.stream_quality(_stream_cells(spark, sf), X.QC), "stream-qc")
    return out.groupBy("treatment", "qc_code").agg(F.count("*").alias("n_cells"))


def stream_scoring(spark, sf):
    c, scaling, _ = dataset.load_model(spark, _saved_model(spark, sf))
    coded = jobs.stream_quality(_stream_cells(spark, sf), X.QC).filter("qc_code = 1")
    out = _drain(spark, jobs.stream_scores(coded, scaling, c).select("treatment", "cluster"), "stream-score")
    return out.groupBy("treatment", "cluster").agg(F.count("*").alias("n_cells"))


def stream_population(spark, sf):
    e = _stream(spark, sf, "events").select(F.col("event_type").alias("treatment"), (F.col("value") > 50).alias("is_non_control"))
    out = _drain(spark, jobs.running_population(e), "stream-population", "complete")
    return out.select("treatment", "n_valid", "n_non_control", r("penetrance"))


def stream_windows(spark, sf):
    """Daily populations whose window the watermark has closed."""
    e = _stream(spark, sf, "events").select("ts", F.col("event_type").alias("treatment"), "value")
    out = _drain(spark, jobs.windowed_population(e), "stream-windows")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "treatment", "n_cells", r("total", 2))


# ---- classifiers --------------------------------------------------------------------


def _labelled(spark, sf):
    return X.points(spark, sf).withColumn("g", F.col("treatment").cast("string"))


def _separability(spark, sf):
    rows = _labelled(spark, sf)
    labels = [x[0] for x in rows.select("g").distinct().orderBy("g").collect()]
    return classify.pairwise_separability(rows, "g", "vec", labels, "object_id")[0]


def svm_separability(spark, sf):
    return _separability(spark, sf)


def separability_dendrogram(spark, sf):
    return linkage.group_dendrogram(classify.separability_map(_separability(spark, sf)), "average")[0]


def _confusion(spark, sf):
    z = B.z_cells(spark, sf)
    return classify.confusion_matrix(z, ["treatment", "replicate"], "vec", "seed_key")


def confusion_matrix(spark, sf):
    return _confusion(spark, sf)


def group_accuracy(spark, sf):
    return classify.group_accuracy(_confusion(spark, sf))


def svm_feature_ranking(spark, sf):
    z = B.z_cells(spark, sf)
    _, models = classify.pairwise_separability(z, "treatment", "vec", ["A", "N"], "seed_key")
    return classify.feature_ranking(models[("A", "N")], X.FEATURES, spark)


def f_test_scores(spark, sf):
    cells = B.valid_cells(spark, sf).withColumns({
        "band": F.floor((F.col("f1") - 1) / 17).cast("string"), "vec": F.array(*X.FEATURES)})
    return classify.f_test_scores(cells, "band", "vec", X.FEATURES).select("feature", r("f_value", 4))


# ---- parameters and extractors ---------------------------------------------------------


def _nation_lists(spark, sf):
    """One list parameter per region, its items separated by all the separators there are."""
    n = X.table(spark, sf, "nation").select(
        F.col("n_regionkey").alias("region"), F.struct("n_nationkey", "n_name").alias("x"))
    items = F.sort_array(F.collect_list("x"))
    texts = F.transform(items, lambda x: F.concat_ws(",", x["n_nationkey"].cast("string"), F.concat(x["n_nationkey"].cast("string"), F.lit(".5")),
                                                     F.concat(F.lit(" "), F.replace(x["n_name"], F.lit(" "), F.lit("_")))))
    return n.groupBy("region").agg(F.array_join(texts, "; ").alias("text"))


def list_parameters(spark, sf):
    """Items of list parameters, as int before float before string."""
    return _nation_lists(spark, sf).select("region", F.posexplode(sweep.typed_items(F.col("text"))).alias("pos", "item")).select(
        "region", "pos", "item.as_int", "item.as_float", "item.as_string")


def _grid(spark, sf):
    names = [r[0] for r in X.table(spark, sf, "region").select("r_name").orderBy("r_name").collect()]
    keys = [r[0] for r in X.table(spark, sf, "nation").select("n_regionkey").distinct().orderBy("n_regionkey").collect()]
    return sweep.parameter_grid(spark, SweepConfig(
        methods=tuple(names), param1=tuple(keys), param2=(-1, 1), param3=(1, 2), param4=(20,), exp_factors=(-1.0, 10.0),
        metrics=("l1_norm", "quadratic_chi")))


def parameter_grid(spark, sf):
    """All combinations of list parameters taken from the dimension tables."""
    return _grid(spark, sf)


def parameter_groups(spark, sf):
    """Parameter sets that differ in the exponent only."""
    return sweep.grid_groups(_grid(spark, sf), "exp_factor").select(
        *[c for c in sweep.GRID_KEYS if c != "exp_factor"], F.array_join(F.col("exp_factor_values").cast("array<string>"), "|").alias("exp_factors"))


def custom_extractors(spark, sf):
    """Well and plate read from columns of another shape by callables, numbered by first appearance."""
    extract = {"row": lambda c: F.substring(c, 1, 1), "number": lambda c: F.regexp_extract(c, "([0-9]+)$", 1)}
    parts = X.table(spark, sf, "part").withColumn("image", F.col("p_brand"))
    for label, get in extract.items():
        parts, _ = csv_sets.encode_dimension(parts, get(F.col("image")), ["p_partkey"], label)
    return parts.groupBy("row_name", "row_index", "number_name", "number_index").agg(F.count("*").alias("n_parts"))


# ---- whole stages ---------------------------------------------------------------------


def _clustered(spark, sf, method="k-means", k=4):
    cells = B.qc_cells(spark, sf)
    flt = FilterConfig(("f1", "f2"), (X.CONTROL,), run_mahal_dist=False)
    out = stages.filter_stage(cells, flt).cells
    return stages.run_clustering(out, X.FEATURES, [X.CONTROL], ClusterConfig(
        method=method, k=k, discard_size=20, dissolve_size=30, max_depth=3))


def clustering_driver(spark, sf):
    res = _clustered(spark, sf)
    return res.cells.groupBy("cluster", "treatment").agg(F.count("*").alias("n_cells"))


def clustering_driver_medians(spark, sf):
    res = _clustered(spark, sf, "k-medians")
    return res.cells.groupBy("cluster").agg(F.count("*").alias("n_cells"))


def profiling_driver(spark, sf):
    out = stages.run_profiling(_clustered(spark, sf), [["treatment"], ["treatment", "replicate"]], ProfileConfig())
    parts = [e["distances"].withColumn("description", F.lit(d)) for d, e in out.items()]
    return parts[0].union(parts[1])


def mahalanobis_profiling(spark, sf):
    """k-means clusters with the group Mahalanobis map instead of profile distances."""
    out = stages.run_profiling(_clustered(spark, sf, "mahalanobis"), [["treatment"]], ProfileConfig(), "mahalanobis")
    return out["treatment"]["distances"]


def component_filter(spark, sf):
    """Control split on two independent components of all four features."""
    cfg = FilterConfig(X.FEATURES, (X.CONTROL,), 1.0, 0.9, valid_only=True)
    return stages.filter_stage(B.qc_cells(spark, sf), cfg, components=2).cells.groupBy("treatment").agg(
        F.sum(F.col("is_non_control").cast("bigint")).alias("n_non_control"))


def parameter_sweep(spark, sf):
    flt = FilterConfig(("f1", "f2"), (X.CONTROL,), run_mahal_dist=False)
    cells = stages.filter_stage(B.qc_cells(spark, sf), flt).cells
    return sweep.run_sweep(cells, X.FEATURES, [X.CONTROL], SweepConfig(
        methods=("k-means", "swap-k-means", "random"), param1=(4, 8), param2=(-1, 3), param4=(2,), exp_factors=(-1.0, 10.0),
        metrics=("summed_minmax", "quadratic_chi", "kolmo_smirnov"), splits=SplitConfig(3, 0.5, 0.0)), "seed_key", replicate="plate")


def sweep_given_centres(spark, sf):
    """Two given models, two exponents, two metrics: all maps and qualities from one pass over the cells."""
    given = {f"given{k}": C.z_model(spark, sf, label, k)[1] for k, label in ((6, C.LABEL), (3, C.COARSE))}
    cfg = SweepConfig(methods=tuple(given), param1=(6,), param4=(0,), exp_factors=(-1.0, 0.0), metrics=("l1_norm", "summed_minmax"),
                      splits=SplitConfig(3, 0.5, 0.0))
    out = sweep.run_sweep(split(spark, sf).cells, X.FEATURES, [X.CONTROL], cfg, "seed_key", replicate="plate", given=given)
    return out.select("method", "n_clusters", "exp_factor", "profile_metric", r("quality"), r("random_quality"), r("replicate_quality"), r("control_distance"))


# ---- SQL --------------------------------------------------------------------------------


def _sweep_sql() -> str:
    ctes = FLTZ + f""",
nc AS (SELECT * FROM z WHERE is_non_control),
elig AS (SELECT treatment FROM nc GROUP BY 1 HAVING count(*) >= 2),
codes AS (SELECT object_id, 'g' AS kind, '' AS o, treatment AS i FROM nc
  UNION ALL SELECT object_id, 'p', treatment, plate::VARCHAR FROM nc WHERE treatment IN (FROM elig)
  UNION ALL SELECT object_id, 'c', '', treatment || '_' || plate FROM nc WHERE treatment = 'N'
  UNION ALL SELECT object_id, 'r', treatment, part::VARCHAR FROM ({split_hits(3, 0.5, 1, "nc")}) WHERE treatment IN (FROM elig)),
size AS (SELECT count(DISTINCT treatment) AS n_groups FROM nc)"""
    rows = []
    for k, label in ((6, C.LABEL), (3, C.COARSE)):
        ctes += f""",
cent{k} AS (SELECT {label} AS cluster, avg(z1) c1, avg(z2) c2, avg(z3) c3, avg(z4) c4 FROM z GROUP BY 1),
delta{k} AS MATERIALIZED (SELECT min({C.d_sql('a.c', 'b.c')}) AS delta FROM cent{k} a JOIN cent{k} b ON a.cluster <> b.cluster),
cd{k} AS (SELECT object_id, cluster, {C.d_sql('z', 'c')} AS d FROM nc CROSS JOIN cent{k})"""
        for e, raw in (("soft", "exp(-d / delta)"), ("flat", """CASE WHEN min(d) OVER (PARTITION BY object_id) = 0
      THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / d END""")):
            t = f"{e}{k}"
            ctes += f""",
s_{t} AS (SELECT object_id, cluster, {raw} AS s FROM cd{k}, delta{k}),
m_{t} AS (SELECT object_id, cluster, s / sum(s) OVER (PARTITION BY object_id) AS m FROM s_{t}),
v_{t} AS (SELECT kind, o, i, cluster, sum(m) AS v FROM codes JOIN m_{t} USING (object_id) GROUP BY ALL),
p_{t} AS MATERIALIZED (SELECT kind, o, i, cluster, v / sum(v) OVER (PARTITION BY kind, o, i) AS p FROM v_{t})"""
            for metric, expr in (("l1_norm", "sum(abs(x.p - y.p))"), ("summed_minmax", "1 - sum(pow(least(x.p, y.p), 2)) / sum(pow(greatest(x.p, y.p), 2))")):
                ctes += f""",
d_{t}_{metric} AS (SELECT x.kind, x.o, {expr} AS d FROM p_{t} x JOIN p_{t} y
  ON x.kind = y.kind AND x.o = y.o AND x.cluster = y.cluster AND x.i > y.i GROUP BY x.kind, x.o, x.i, y.i),
q_{t}_{metric} AS (SELECT avg(d) FILTER (kind = 'g') AS g, avg(d) FILTER (kind = 'r') AS r, avg(d) FILTER (kind = 'p') AS p,
  avg(d) FILTER (kind = 'c') AS c, count(*) FILTER (kind = 'r') AS n FROM (SELECT kind, o, avg(d) AS d FROM d_{t}_{metric} GROUP BY 1, 2))"""
                rows.append(f"""SELECT 'given{k}' AS method, {k} AS n_clusters, {-1.0 if e == 'soft' else 0.0}::DOUBLE AS exp_factor, '{metric}' AS profile_metric,
  round(g - CASE WHEN n = n_groups THEN r ELSE 0 END, 6) + 0.0 AS quality, round(g - r, 6) + 0.0 AS random_quality,
  round(g - p, 6) + 0.0 AS replicate_quality, round(c, 6) + 0.0 AS control_distance FROM q_{t}_{metric}, size""")
    return W(ctes.replace("GROUP BY ALL", "GROUP BY kind, o, i, cluster"), " UNION ALL ".join(rows))


LABELS = ", ".join(f"'[{i}]'" for i in range(12))
GRID = """SELECT r_name AS method, param1, param2, param3, 20.0::DOUBLE AS param4, exp_factor, profile_metric FROM region
  CROSS JOIN (SELECT DISTINCT n_regionkey::DOUBLE AS param1 FROM nation) CROSS JOIN (VALUES (-1.0::DOUBLE), (1.0)) a(param2)
  CROSS JOIN (VALUES (1.0::DOUBLE), (2.0)) b(param3) CROSS JOIN (VALUES (-1.0::DOUBLE), (10.0)) c(exp_factor)
  CROSS JOIN (VALUES ('l1_norm'), ('quadratic_chi')) d(profile_metric)"""

QUERIES = {
    "csv_import": (csv_import, W(B.CELLS, """SELECT supplier_id AS image_no, 'W' || supplier_id % 12 AS "Metadata_Well",
       'img/dapi/' || supplier_id || '.tif' AS file, count(*) AS n_objects, round(sum(f2), 2) + 0.0 AS sum_f2,
       round(sum(f3), 4) + 0.0 AS sum_f3 FROM cells WHERE supplier_id % 10 <> 0 GROUP BY supplier_id""")),
    "csv_incomplete_sets": (csv_incomplete_sets, """SELECT DISTINCT l_suppkey AS image_no, '_Cells' AS kind
       FROM lineitem WHERE l_suppkey % 10 = 0"""),
    "csv_type_inference": (csv_type_inference, """SELECT 'f1' AS column_name, CASE WHEN bool_and(
       TRY_CAST(CAST(l_quantity AS varchar) AS double) IS NOT NULL) THEN 'double' ELSE 'string' END AS column_type FROM lineitem
       UNION ALL SELECT 'f3', CASE WHEN bool_and(l_linenumber <> 7) THEN 'double' ELSE 'string' END FROM lineitem
       UNION ALL SELECT 'treatment', CASE WHEN bool_and(TRY_CAST(l_returnflag AS double) IS NOT NULL) THEN 'double' ELSE 'string' END FROM lineitem
       UNION ALL SELECT 'well', 'string'"""),
    "image_file_list": (image_file_list, """SELECT o_orderkey AS image_id, 'DAPI' AS entity,
       o_orderpriority || '/' || o_orderkey || '.tif' AS path FROM orders"""),
    "dimension_encoding": (dimension_encoding, W(B.CELLS + """,
t AS (SELECT treatment, CAST(row_number() OVER (ORDER BY m) - 1 AS int) AS i FROM (
  SELECT treatment, min((image_id, object_id)) AS m FROM cells GROUP BY 1)),
w AS (SELECT well, CAST(row_number() OVER (ORDER BY m) - 1 AS int) AS i FROM (
  SELECT well, min((image_id, object_id)) AS m FROM cells GROUP BY 1))""", """SELECT treatment AS treatment_name,
  t.i AS treatment_index, CAST(well AS varchar) AS well_name, w.i AS well_index, count(*) AS n_cells
  FROM cells JOIN t USING (treatment) JOIN w USING (well) GROUP BY treatment, t.i, well, w.i""")),
    "list_parameters": (list_parameters, r"""WITH t AS (SELECT n_regionkey AS region, string_agg(n_nationkey || ',' || n_nationkey || '.5, '
  || replace(n_name, ' ', '_'), '; ' ORDER BY n_nationkey) AS text FROM nation GROUP BY 1),
i AS (SELECT region, list_filter(regexp_split_to_array(text, '[\s,;]+'), lambda x: x <> '') AS items FROM t),
e AS (SELECT region, unnest(items) AS item, (generate_subscripts(items, 1) - 1)::INT AS pos FROM i)
SELECT region, pos, CASE WHEN item NOT LIKE '%.%' THEN try_cast(item AS BIGINT) END AS as_int, try_cast(item AS DOUBLE) AS as_float, item AS as_string FROM e"""),
    "parameter_grid": (parameter_grid, GRID),
    "parameter_groups": (parameter_groups, f"""SELECT method, param1, param2, param3, param4, profile_metric,
  string_agg(exp_factor::VARCHAR, '|' ORDER BY exp_factor) AS exp_factors FROM ({GRID}) GROUP BY ALL"""),
    "custom_extractors": (custom_extractors, """WITH p AS (SELECT p_partkey, left(p_brand, 1) AS row_name, regexp_extract(p_brand, '([0-9]+)$', 1) AS number_name FROM part),
r AS (SELECT row_name, (row_number() OVER (ORDER BY min(p_partkey), row_name) - 1)::INT AS row_index FROM p GROUP BY 1),
n AS (SELECT number_name, (row_number() OVER (ORDER BY min(p_partkey), number_name) - 1)::INT AS number_index FROM p GROUP BY 1)
SELECT row_name, row_index, number_name, number_index, count(*) AS n_parts FROM p JOIN r USING (row_name) JOIN n USING (number_name) GROUP BY ALL"""),
    "virtual_ids": (virtual_ids, """SELECT CAST(0 AS bigint) AS plate, 0 AS quality_control, count(*) AS n_cells,
       count(DISTINCT l_orderkey) AS n_images FROM lineitem"""),
    "database_selection": (database_selection, W(B.CELLS, """SELECT image_id, object_id, f1, f2 FROM cells WHERE image_id IN (
       SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH'))""")),
    "treatment_filter_file": (treatment_filter_file, """SELECT p_brand, count(*) AS n_parts FROM part
       WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 45) GROUP BY 1"""),
    "dataset_roundtrip": (dataset_roundtrip, W(B.QC, """SELECT treatment, is_valid, count(*) AS n_cells,
       round(sum(f1), 2) + 0.0 AS sum_f1, 4 AS n_features FROM qc GROUP BY 1, 2""")),
    "dataset_merge": (dataset_merge, W(B.CELLS + """,
m AS (SELECT f1, image_id % 2 AS no, CASE WHEN treatment = 'N' THEN 'mock1' ELSE treatment END AS treatment,
  CASE WHEN image_id % 2 = 1 AND replicate = 'O' THEN '1' ELSE replicate END AS replicate FROM cells),
t AS (SELECT treatment, CAST(row_number() OVER (ORDER BY min(no), treatment) - 1 AS int) AS treatment_index FROM m GROUP BY 1),
p AS (SELECT replicate, CAST(row_number() OVER (ORDER BY min(no), replicate) - 1 AS int) AS replicate_index FROM m GROUP BY 1)""",
       """SELECT treatment, treatment_index, replicate, replicate_index, count(*) AS n_cells, round(sum(f1), 2) + 0.0 AS sum_f1
       FROM m JOIN t USING (treatment) JOIN p USING (replicate) GROUP BY 1, 2, 3, 4""")),
    "model_scoring": (model_scoring, W(
        C.MODEL, """SELECT object_id, cluster AS "ClusterID", round(d, 6) + 0.0 AS distance FROM asg""")),
    "state_roundtrip": (state_roundtrip, W(
        B.QC, "SELECT qc_code, image_code, count(*) AS n_cells FROM qc GROUP BY 1, 2")),
    "heatmap_export": (heatmap_export, W(WELLS + f", heat AS ({heat_sql('l1_norm')})", f"""
       SELECT 'l1 distances' AS line UNION ALL SELECT chr(9) || list_aggregate([{LABELS}], 'string_agg', chr(9))
       UNION ALL SELECT row_group || chr(9) || string_agg(printf('%.6f', distance), chr(9)
         ORDER BY list_position([{LABELS}], col_group)) FROM heat GROUP BY row_group""")),
    "feature_export": (feature_export, W(B.QC, """SELECT chr(9) || '0' || chr(9) || '1' AS line UNION ALL
       SELECT chr(9) || 'f1' || chr(9) || 'f3' UNION ALL
       SELECT object_id || chr(9) || printf('%.6f', f1) || chr(9) || printf('%.6f', f3) FROM valid""")),
    "stream_quality": (stream_quality, W(
        B.CODED, "SELECT treatment, qc_code, count(*) AS n_cells FROM coded GROUP BY 1, 2")),
    "stream_scoring": (stream_scoring, W(C.MODEL + f""",
sz AS (SELECT object_id, treatment, (f1-m1)/s1 AS z1, (f2-m2)/s2 AS z2, (f3-m3)/s3 AS z3, (f4-m4)/s4 AS z4
  FROM coded, scaling WHERE qc_code = 1),
sc AS (SELECT object_id, treatment, min_by(cluster, (d, cluster)) AS cluster FROM (
  SELECT object_id, treatment, cluster, {C.d_sql('z', 'c')} AS d FROM sz CROSS JOIN cent) GROUP BY 1, 2)""",
       "SELECT treatment, cluster, count(*) AS n_cells FROM sc GROUP BY 1, 2")),
    "stream_population": (stream_population, """SELECT event_type AS treatment, count(*) AS n_valid,
       count(CASE WHEN value > 50 THEN 1 END) AS n_non_control,
       round(count(CASE WHEN value > 50 THEN 1 END) / CAST(count(*) AS double), 6) + 0.0 AS penetrance FROM events GROUP BY 1"""),
    "stream_windows": (stream_windows, """WITH mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
       SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS treatment, count(*) AS n_cells,
       round(sum(value), 2) + 0.0 AS total FROM events, mark WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= mark GROUP BY 1, 2"""),
    "svm_separability": (svm_separability, None),
    "separability_dendrogram": (separability_dendrogram, None),
    "confusion_matrix": (confusion_matrix, None),
    "group_accuracy": (group_accuracy, None),
    "svm_feature_ranking": (svm_feature_ranking, None),
    "f_test_scores": (f_test_scores, W(B.QC + """,
long AS (SELECT floor((f1 - 1) / 17) AS band, unnest(['f1','f2','f3','f4']) AS feature, unnest([f1, f2, f3, f4]) AS x FROM valid),
g AS (SELECT feature, band, count(*) AS n, avg(x) AS m, sum((x - gm) * (x - gm)) AS total FROM (
  SELECT *, avg(x) OVER (PARTITION BY feature) AS gm FROM long) GROUP BY 1, 2),
o AS (SELECT feature, avg(x) AS gm, count(*) AS n FROM long GROUP BY 1),
f AS (SELECT feature, sum(g.n*(m-gm)*(m-gm)) AS ssb, sum(total) AS sst, any_value(o.n) AS n, count(*) AS k FROM g JOIN o USING (feature) GROUP BY 1)""",
       """SELECT feature, round((ssb/(k-1)) / ((sst-ssb)/(n-k)), 4) + 0.0 AS f_value FROM f
       WHERE pow((n-k) / ((n-k) + 2.0 * (ssb/(k-1)) / ((sst-ssb)/(n-k))), (n-k)/2.0) < 0.1""")),
    "clustering_driver": (clustering_driver, None),
    "clustering_driver_medians": (clustering_driver_medians, None),
    "profiling_driver": (profiling_driver, None),
    "mahalanobis_profiling": (mahalanobis_profiling, None),
    "component_filter": (component_filter, None),
    "parameter_sweep": (parameter_sweep, None),
    "sweep_given_centres": (sweep_given_centres, _sweep_sql()),
}
