"""Quality control, selections and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave import fixtures as X
from cellweave import model as M
from cellweave.operators import controls, grouping, masks, order_stats, quality
from cellweave.queries import base as B

NAN = "CASE WHEN line_no = 7 THEN CAST('NaN' AS double) ELSE f2 END"


def with_bad_values(df):
    """f2 is NaN on line 7, f3 is ∞ on line 6."""
    return df.withColumns({
        "f2": F.when(F.col("line_no") == 7, F.lit(float("nan"))).otherwise(F.col("f2")),
        "f3": F.when(F.col("line_no") == 6, F.lit(float("inf"))).otherwise(F.col("f3"))})


def split(spark, sf):
    return controls.split_controls(B.qc_cells(spark, sf), X.FILTER)


def qc_cell_codes(spark, sf):
    return B.coded_cells(spark, sf).select("object_id", "qc_code")


def qc_code_counts(spark, sf):
    return quality.code_counts(B.coded_cells(spark, sf))


def qc_image_codes(spark, sf):
    return quality.image_codes(X.images(spark, sf), B.coded_cells(spark, sf), X.QC).select(
        "image_id", "n_valid", B.r("cell_area", 3), "image_code")


def qc_valid_cells(spark, sf):
    return B.qc_cells(spark, sf).select("object_id", "qc_code", "image_code", "is_valid")


def qc_image_summary(spark, sf):
    return quality.image_summary(quality.image_codes(X.images(spark, sf), B.coded_cells(spark, sf), X.QC))


def qc_code_labels(spark, sf):
    return quality.with_code_text(quality.code_counts(B.coded_cells(spark, sf)))


def bad_feature_counts(spark, sf):
    return masks.bad_feature_counts(with_bad_values(B.qc_cells(spark, sf)), X.FEATURES)


def cells_without_bad_features(spark, sf):
    cells = masks.reject_bad_features(with_bad_values(B.qc_cells(spark, sf)), ["f2", "f3"])
    return cells.filter("is_valid").select("object_id", "treatment")


def control_mask(spark, sf):
    return B.qc_cells(spark, sf).withColumn("is_control", masks.is_control([X.CONTROL])).groupBy("is_control").agg(
        F.count("*").alias("n_cells"), F.sum(F.col("is_valid").cast("bigint")).alias("n_valid"))


def manual_rejection(spark, sf):
    out = masks.reject_treatments(split(spark, sf).cells, ["R"])
    return out.groupBy("treatment").agg(
        F.sum(F.col("is_control_like").cast("bigint")).alias("n_control_like"),
        F.sum(F.col("is_non_control").cast("bigint")).alias("n_non_control"))


def mask_algebra(spark, sf):
    a, b = F.col("f1") > 25, F.col("is_valid")
    named = {"both": masks.mask_and(a, b), "either": masks.mask_or(a, b), "complement": masks.mask_not(a)}
    return B.qc_cells(spark, sf).groupBy("treatment").agg(
        *[F.sum(m.cast("bigint")).alias(n) for n, m in named.items()])


def cell_selection(spark, sf):
    cells = split(spark, sf).cells
    return cells.filter(masks.cell_selection("noncontrol", "valid", treatment="A", replicate="F", well=3)).select(
        "object_id", B.r("mahal_dist"))


def invalid_cell_selection(spark, sf):
    return B.qc_cells(spark, sf).filter(masks.cell_selection("invalid", treatment="R")).select("object_id", "qc_code")


def image_selection(spark, sf):
    codes = quality.image_codes(X.images(spark, sf), B.coded_cells(spark, sf), X.QC)
    images = X.images(spark, sf).join(codes.select("image_id", "image_code"), "image_id")
    return images.filter(masks.image_selection("valid", "noncontrol", controls=["O"], treatment="F")).select(
        "image_id", "treatment", "image_code")


def user_filter_sort(spark, sf):
    view = quality.with_code_text(B.qc_cells(spark, sf))
    return masks.user_filter(
        view, "qc_text = 'too small nucleus solidity' and f1 * f2 > 1000000 and treatment <> 'N'",
        "f2 / f1 desc").select("object_id", "treatment", "f1", "f2")


def append_derived_feature(spark, sf):
    cells = masks.append_feature(B.qc_cells(spark, sf), "unit_value", F.col("f2") / F.col("f1"), F.col("is_valid"))
    cells = masks.append_feature(cells, "ClusterID", F.col("well"), F.col("is_valid"), -1)
    return cells.select("object_id", "unit_value", F.col("ClusterID").cast("bigint").alias("ClusterID"))


def feature_projection(spark, sf):
    out = masks.project_features(B.valid_cells(spark, sf), ["f4", "f2"])
    return out.select("object_id", F.col("vec")[0].alias("v0"), F.col("vec")[1].alias("v1"))


def objects_join_images(spark, sf):
    return X.cells(spark, sf).join(X.images(spark, sf).select("image_id", "priority"), "image_id").groupBy(
        "priority").agg(F.count("*").alias("n_cells"), B.r(F.sum("f1"), 2, "sum_f1"))


def dimension_lookup(spark, sf):
    """Supplier → nation → region names looked up for every cell (well → plate hierarchy)."""
    sup = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier_id"), "s_nationkey")
    nat = X.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    reg = X.table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return X.cells(spark, sf).join(sup, "supplier_id").join(nat, "s_nationkey").join(reg, "n_regionkey").groupBy(
        "n_name", "r_name").agg(F.count("*").alias("n_cells"))


def semi_join_filter_list(spark, sf):
    keep = X.table(spark, sf, "part").filter("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("part_id"))
    return X.cells(spark, sf).join(keep, "part_id", "left_semi").groupBy("treatment").agg(
        F.count("*").alias("n_cells"))


def anti_join_missing(spark, sf):
    """Images without any object."""
    return X.images(spark, sf).join(X.cells(spark, sf).select("image_id"), "image_id", "left_anti").select("image_id")


MEMBERS = "is_valid AND f2 > 60000"


def groups_by_treatment(spark, sf):
    return grouping.group_counts(B.qc_cells(spark, sf), ["treatment"], F.col("is_valid"), reject=["R"])


def groups_by_well(spark, sf):
    return grouping.group_counts(B.qc_cells(spark, sf), ["well"], F.col("is_valid"))


def groups_by_replicate(spark, sf):
    return grouping.group_counts(B.qc_cells(spark, sf), ["replicate"], F.col("is_valid"))


def group_combinations(spark, sf):
    return grouping.group_counts(B.qc_cells(spark, sf), ["treatment", "replicate", "well"], F.expr(MEMBERS))


def nested_groups(spark, sf):
    nested = grouping.nested_counts(B.qc_cells(spark, sf), "treatment", "well", F.expr(MEMBERS))
    return grouping.flatten_groups(nested, "treatment")


GROUPS = [("low", "f1 < 20"), ("high", "f1 > 15"), ("discounted", "f3 >= 0.05"), ("never", "f1 < 0")]


def custom_groups(spark, sf):
    return grouping.custom_groups(B.valid_cells(spark, sf), GROUPS).groupBy("group_name").agg(
        F.count("*").alias("n_cells"), B.r(F.avg("f2"), 4, "mean_f2"))


def joined_groups(spark, sf):
    members = grouping.custom_groups(B.valid_cells(spark, sf), [GROUPS[0], GROUPS[2]])
    return grouping.joined_members(members)


def control_groups(spark, sf):
    return grouping.control_groups(B.qc_cells(spark, sf), [X.CONTROL, "A"], F.col("is_valid"))


def group_subtotals(spark, sf):
    return grouping.hierarchy_subtotals(B.valid_cells(spark, sf))


def selection_intersection(spark, sf):
    v = B.valid_cells(spark, sf)
    return v.filter("f1 > 25").select("object_id").intersect(v.filter("f3 > 0.05").select("object_id"))


def selection_difference(spark, sf):
    v = B.valid_cells(spark, sf)
    return v.filter("f1 > 25").select("object_id").subtract(v.filter("f3 > 0.05").select("object_id"))


def selection_union(spark, sf):
    v = B.valid_cells(spark, sf)
    return v.filter("f1 > 40").select("object_id").union(v.filter("f3 > 0.08").select("object_id")).distinct()


def selection_disjoint(spark, sf):
    v = B.valid_cells(spark, sf)
    return masks.disjoint(v.filter("f1 > 40"), v.filter("f3 > 0.08"))


def distinct_filter_values(spark, sf):
    return masks.distinct_values(X.cells(spark, sf), "plate")


def rank_in_group_order(spark, sf):
    return order_stats.distributed_rank(
        B.valid_cells(spark, sf).select("object_id", "treatment"), ["treatment", "object_id"]).select(
        "object_id", F.col("position").cast("bigint").alias("position"))


def rank_within_group(spark, sf):
    return order_stats.distributed_rank(
        B.valid_cells(spark, sf).select("object_id", "treatment", "f2"), ["f2", "object_id"], ["treatment"]).select(
        "object_id", "treatment", F.col("position").cast("bigint").alias("position"))


def selection_page(spark, sf):
    return order_stats.page(B.valid_cells(spark, sf).select("object_id", "f2"), ["f2", "object_id"], 20, 50).select(
        "object_id", "f2", F.col("position").cast("bigint").alias("position"))


def random_sample(spark, sf):
    """Seeded random sample of 100 rows."""
    from cellweave.functions.scalars import portable_hash
    return B.valid_cells(spark, sf).withColumn("h", portable_hash("seed_key", 7)).orderBy("h", "object_id").limit(
        100).select("object_id")


def every_nth_row(spark, sf):
    return order_stats.every_nth(B.valid_cells(spark, sf).select("object_id"), ["object_id"], 50).select("object_id")


def scalar_text_functions(spark, sf):
    from cellweave.functions.scalars import rename_wild_type
    p = X.table(spark, sf, "part")
    return p.select(
        "p_partkey", F.split("p_name", " ")[0].alias("prefix"),
        F.regexp_extract("p_name", "([^ ]+)$", 1).alias("postfix"),
        F.concat_ws("/", "p_type", "p_name").alias("path"),
        F.try_to_number(F.substring("p_brand", 7, 10), F.lit("999")).cast("double").alias("brand_no"),
        rename_wild_type(F.when(F.col("p_size") < 10, F.concat(F.lit("wt"), F.col("p_size").cast("string")))
                         .otherwise(F.col("p_type"))).alias("renamed"))


W = B.with_sql
QUERIES = {
    "qc_cell_codes": (qc_cell_codes, W(B.CODED, "SELECT object_id, qc_code FROM coded")),
    "qc_code_counts": (qc_code_counts, W(B.CODED, "SELECT qc_code, count(*) AS n_cells FROM coded GROUP BY qc_code")),
    "qc_image_codes": (qc_image_codes, W(
        B.IMAGES, "SELECT image_id, n_valid, round(cell_area, 3) + 0.0 AS cell_area, image_code FROM image_qc")),
    "qc_valid_cells": (qc_valid_cells, W(B.QC, "SELECT object_id, qc_code, image_code, is_valid FROM qc")),
    "qc_image_summary": (qc_image_summary, W(B.IMAGES, """SELECT image_code, count(*) AS n_images,
       CAST(sum(n_valid) AS bigint) AS n_valid_cells FROM image_qc GROUP BY image_code""")),
    "qc_code_labels": (qc_code_labels, W(B.CODED, "SELECT qc_code, count(*) AS n_cells, CASE qc_code "
       + " ".join(f"WHEN {k} THEN '{v}'" for k, v in M.QC_TEXT.items())
       + " END AS qc_text FROM coded GROUP BY qc_code")),
    "bad_feature_counts": (bad_feature_counts, W(B.QC, """
       SELECT 'f1' AS feature, CAST(0 AS bigint) AS n_bad UNION ALL SELECT 'f3', 0 UNION ALL SELECT 'f4', 0
       UNION ALL SELECT 'f2', count(*) FROM valid WHERE line_no = 7""")),
    "cells_without_bad_features": (cells_without_bad_features, W(
        B.QC, "SELECT object_id, treatment FROM valid WHERE line_no <> 7")),
    "control_mask": (control_mask, W(B.QC, """SELECT treatment = 'N' AS is_control, count(*) AS n_cells,
       count(CASE WHEN is_valid THEN 1 END) AS n_valid FROM qc GROUP BY 1""")),
    "manual_rejection": (manual_rejection, W(B.FLT, """SELECT treatment,
       count(CASE WHEN is_control_like OR (is_non_control AND treatment = 'R') THEN 1 END) AS n_control_like,
       count(CASE WHEN is_non_control AND treatment <> 'R' THEN 1 END) AS n_non_control FROM flt GROUP BY treatment""")),
    "mask_algebra": (mask_algebra, W(B.QC, """SELECT treatment, count(CASE WHEN f1 > 25 AND is_valid THEN 1 END) AS "both",
       count(CASE WHEN f1 > 25 OR is_valid THEN 1 END) AS either,
       count(CASE WHEN NOT f1 > 25 THEN 1 END) AS complement FROM qc GROUP BY treatment""")),
    "cell_selection": (cell_selection, W(B.FLT, """SELECT object_id, round(mahal_dist, 6) + 0.0 AS mahal_dist FROM flt
       WHERE is_non_control AND treatment = 'A' AND replicate = 'F' AND well = 3""")),
    "invalid_cell_selection": (invalid_cell_selection, W(
        B.QC, "SELECT object_id, qc_code FROM qc WHERE NOT is_valid AND treatment = 'R'")),
    "image_selection": (image_selection, W(B.IMAGES, """SELECT image_id, o_orderstatus AS treatment, image_code
       FROM image_qc JOIN orders ON o_orderkey = image_id WHERE image_code = 0 AND o_orderstatus = 'F'""")),
    "user_filter_sort": (user_filter_sort, W(B.CODED, """SELECT object_id, treatment, f1, f2 FROM coded
       WHERE qc_code = 2006 AND f1 * f2 > 1000000 AND treatment <> 'N' ORDER BY f2 / f1 DESC, object_id""")),
    "append_derived_feature": (append_derived_feature, W(B.QC, """SELECT object_id,
       CASE WHEN is_valid THEN f2 / f1 ELSE CAST('inf' AS double) END AS unit_value,
       CASE WHEN is_valid THEN well ELSE -1 END AS "ClusterID" FROM qc""")),
    "feature_projection": (feature_projection, W(B.QC, "SELECT object_id, f4 AS v0, f2 AS v1 FROM valid")),
    "objects_join_images": (objects_join_images, W(B.CELLS, """SELECT o_orderpriority AS priority, count(*) AS n_cells,
       round(sum(f1), 2) + 0.0 AS sum_f1 FROM cells JOIN orders ON o_orderkey = image_id GROUP BY 1""")),
    "dimension_lookup": (dimension_lookup, W(B.CELLS, """SELECT n_name, r_name, count(*) AS n_cells FROM cells
       JOIN supplier ON s_suppkey = supplier_id JOIN nation ON n_nationkey = s_nationkey
       JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")),
    "semi_join_filter_list": (semi_join_filter_list, W(B.CELLS, """SELECT treatment, count(*) AS n_cells FROM cells
       WHERE part_id IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2') GROUP BY 1""")),
    "anti_join_missing": (anti_join_missing, """SELECT o_orderkey AS image_id FROM orders
       WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""),
    "groups_by_treatment": (groups_by_treatment, W(B.QC, """SELECT treatment, treatment AS group_name,
       count(CASE WHEN is_valid THEN 1 END) AS n_cells FROM qc WHERE treatment <> 'R' GROUP BY 1""")),
    "groups_by_well": (groups_by_well, W(B.QC, """SELECT well, '[' || well || ']' AS group_name,
       count(CASE WHEN is_valid THEN 1 END) AS n_cells FROM qc GROUP BY 1""")),
    "groups_by_replicate": (groups_by_replicate, W(B.QC, """SELECT replicate, '[' || replicate || ']' AS group_name,
       count(CASE WHEN is_valid THEN 1 END) AS n_cells FROM qc GROUP BY 1""")),
    "group_combinations": (group_combinations, W(B.QC, """SELECT t.treatment, r.replicate, w.well,
       t.treatment || ',[' || r.replicate || '],[' || w.well || ']' AS group_name, count(q.object_id) AS n_cells
       FROM (SELECT DISTINCT treatment FROM qc) t CROSS JOIN (SELECT DISTINCT replicate FROM qc) r
       CROSS JOIN (SELECT DISTINCT well FROM qc) w
       LEFT JOIN (SELECT * FROM valid WHERE f2 > 60000) q
         ON q.treatment = t.treatment AND q.replicate = r.replicate AND q.well = w.well
       GROUP BY t.treatment, r.replicate, w.well""")),
    "nested_groups": (nested_groups, W(B.QC, """SELECT treatment,
       CAST(sum(n_cells) OVER (PARTITION BY treatment) AS bigint) AS n_outer, inner_group, n_cells FROM (
       SELECT t.treatment, w.well AS inner_group, count(q.object_id) AS n_cells
       FROM (SELECT DISTINCT treatment FROM qc) t CROSS JOIN (SELECT DISTINCT well FROM qc) w
       LEFT JOIN (SELECT * FROM valid WHERE f2 > 60000) q ON q.treatment = t.treatment AND q.well = w.well
       GROUP BY t.treatment, w.well)""")),
    "custom_groups": (custom_groups, W(B.QC, " UNION ALL ".join(
        f"SELECT '{n}' AS group_name, count(*) AS n_cells, round(avg(f2), 4) + 0.0 AS mean_f2 FROM valid WHERE {p} HAVING count(*) > 0"
        for n, p in GROUPS))),
    "joined_groups": (joined_groups, W(B.QC, "SELECT object_id FROM valid WHERE f1 < 20 OR f3 >= 0.05")),
    "control_groups": (control_groups, W(B.QC, """SELECT treatment, replicate, count(*) AS n_cells,
       treatment || '_' || replicate AS group_name FROM valid WHERE treatment IN ('N', 'A') GROUP BY 1, 2""")),
    "group_subtotals": (group_subtotals, W(B.QC, """SELECT coalesce(treatment, '*') AS treatment,
       coalesce(replicate, '*') AS replicate, coalesce(CAST(well AS varchar), '*') AS well, count(*) AS n_cells
       FROM valid GROUP BY ROLLUP (treatment, replicate, well)""")),
    "selection_intersection": (selection_intersection, W(
        B.QC, "SELECT object_id FROM valid WHERE f1 > 25 AND f3 > 0.05")),
    "selection_difference": (selection_difference, W(
        B.QC, "SELECT object_id FROM valid WHERE f1 > 25 AND NOT f3 > 0.05")),
    "selection_union": (selection_union, W(B.QC, "SELECT object_id FROM valid WHERE f1 > 40 OR f3 > 0.08")),
    "selection_disjoint": (selection_disjoint, W(
        B.QC, "SELECT count(*) AS n_shared, count(*) = 0 AS is_disjoint FROM valid WHERE f1 > 40 AND f3 > 0.08")),
    "distinct_filter_values": (distinct_filter_values, "SELECT DISTINCT l_suppkey % 4 AS plate FROM lineitem"),
    "rank_in_group_order": (rank_in_group_order, W(
        B.QC, "SELECT object_id, row_number() OVER (ORDER BY treatment, object_id) AS position FROM valid")),
    "rank_within_group": (rank_within_group, W(B.QC, """SELECT object_id, treatment,
       row_number() OVER (PARTITION BY treatment ORDER BY f2, object_id) AS position FROM valid""")),
    "selection_page": (selection_page, W(B.QC, """SELECT * FROM (SELECT object_id, f2,
       row_number() OVER (ORDER BY f2, object_id) AS position FROM valid) WHERE position > 20 AND position <= 50""")),
    "random_sample": (random_sample, W(B.QC, "SELECT object_id FROM valid ORDER BY "
       "{h}, object_id LIMIT 100")),
    "every_nth_row": (every_nth_row, W(B.QC, """SELECT object_id FROM (SELECT object_id,
       row_number() OVER (ORDER BY object_id) AS rn FROM valid) WHERE (rn - 1) % 50 = 0""")),
    "scalar_text_functions": (scalar_text_functions, """SELECT p_partkey, split_part(p_name, ' ', 1) AS prefix,
       regexp_extract(p_name, '([^ ]+)$', 1) AS postfix, concat_ws('/', p_type, p_name) AS path,
       TRY_CAST(substr(p_brand, 7) AS double) AS brand_no,
       CASE WHEN p_size < 10 THEN replace('wt' || p_size, 'wt', 'mock') ELSE p_type END AS renamed FROM part"""),
}
from cellweave.functions.scalars import portable_hash_sql  # noqa: E402

_fn, _sql = QUERIES["random_sample"]
QUERIES["random_sample"] = (_fn, _sql.replace("{h}", portable_hash_sql("seed_key", 7)))
