"""Selections: boolean columns, predicates and derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.scalars import is_finite
from cellweave.functions.vectors import vector


def has_nan(features: Sequence[str]) -> Column:
    bad = F.lit(False)
    for f in features:
        bad = bad | F.isnan(F.col(f).cast("double"))
    return bad


def reject_bad_features(cells: DataFrame, features: Sequence[str], valid: str = "is_valid") -> DataFrame:
    """Valid cells with NaN in a selected feature become invalid; Inf passes, no features is a no-op."""
    return cells.withColumn(valid, F.col(valid) & ~has_nan(features))


def bad_feature_counts(cells: DataFrame, features: Sequence[str], valid: str = "is_valid") -> DataFrame:
    """NaN count among valid cells per feature, all features in one aggregate."""
    sums = cells.filter(F.col(valid)).agg(
        *[F.coalesce(F.sum(F.isnan(F.col(f).cast("double")).cast("bigint")), F.lit(0)).alias(f) for f in features])
    return sums.unpivot([], list(features), "feature", "n_bad")


def is_control(names: Sequence[str], column: str = "treatment") -> Column:
    return F.col(column).isin(list(names))


def reject_treatments(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """Non-control cells of rejected treatments become control-like."""
    hit = F.col("is_non_control") & F.col("treatment").isin(list(names))
    return cells.withColumns({
        "is_control_like": F.col("is_control_like") | hit,
        "is_non_control": F.col("is_non_control") & ~hit,
    })


def mask_and(*masks: Column) -> Column:
    out = masks[0]
    for m in masks[1:]:
        out = out & m
    return out


def mask_or(*masks: Column) -> Column:
    out = masks[0]
    for m in masks[1:]:
        out = out | m
    return out


def mask_not(mask: Column) -> Column:
    return ~mask


# Flag → column of the filtered cell table.
FLAGS = {
    "control": "is_control_like",
    "noncontrol": "is_non_control",
    "valid": "is_valid",
}


def cell_selection(*flags: str, well=None, treatment=None, replicate=None) -> Column:
    """AND of the flags and of the given well, treatment and replicate."""
    masks = [~F.col("is_valid") if f == "invalid" else F.col(FLAGS[f]) for f in flags]
    for name, wanted in (("well", well), ("treatment", treatment), ("replicate", replicate)):
        if wanted is not None:
            masks.append(F.col(name) == F.lit(wanted))
    return mask_and(F.lit(True), *masks)


def image_selection(*flags: str, controls: Sequence[str] = (), well=None, treatment=None,
                    replicate=None) -> Column:
    """Same on images: a (non-)control image belongs to a (non-)control treatment."""
    masks = []
    for f in flags:
        if f in ("control", "noncontrol"):
            c = F.col("treatment").isin(list(controls))
            masks.append(c if f == "control" else ~c)
        else:
            ok = F.col("image_code") == 0
            masks.append(ok if f == "valid" else ~ok)
    for name, wanted in (("well", well), ("treatment", treatment), ("replicate", replicate)):
        if wanted is not None:
            masks.append(F.col(name) == F.lit(wanted))
    return mask_and(F.lit(True), *masks)


def user_filter(df: DataFrame, predicate: str | None = None, sort_by: str | None = None,
                id_col: str = "object_id") -> DataFrame:
    """Arbitrary SQL predicate and sort expression over the columns of the selection view."""
    out = df if not predicate else df.filter(F.expr(predicate))
    if sort_by:
        out = out.orderBy(F.expr(sort_by), F.col(id_col))
    return out


def append_feature(cells: DataFrame, name: str, value: Column, where: Column | None = None,
                   otherwise: float = float("inf")) -> DataFrame:
    """New feature column; rows outside ``where`` get the filler (∞ for distances, −1 for ids)."""
    col = value if where is None else F.when(where, value).otherwise(F.lit(otherwise))
    return cells.withColumn(name, col)


def project_features(cells: DataFrame, features: Sequence[str], keep: Sequence[str] = ("object_id",)) -> DataFrame:
    return cells.select(*keep, vector(features).alias("vec"))


def finite_groups(heatmap: DataFrame, first_group, require_both: bool = False) -> DataFrame:
    """Keep groups whose entry in the first row or first column is finite.

    Long heatmap (row_group, col_group, distance). Both axes are filtered by
    semi joins on the surviving group names.
    """
    ok = is_finite(F.col("distance"))
    in_row = heatmap.filter(F.col("row_group") == F.lit(first_group)).filter(ok).select(F.col("col_group").alias("g"))
    in_col = heatmap.filter(F.col("col_group") == F.lit(first_group)).filter(ok).select(F.col("row_group").alias("g"))
    keep = in_row.intersect(in_col) if require_both else in_row.union(in_col).distinct()
    return (
        heatmap.join(keep.withColumnRenamed("g", "row_group"), "row_group", "left_semi")
        .join(keep.withColumnRenamed("g", "col_group"), "col_group", "left_semi")
        .select(*heatmap.columns)
    )


def disjoint(a: DataFrame, b: DataFrame, on: str = "object_id") -> DataFrame:
    """One row: number of shared ids and whether the selections are disjoint."""
    shared = a.select(on).join(b.select(on), on, "left_semi").distinct()
    return shared.agg(F.count("*").alias("n_shared")).withColumn("is_disjoint", F.col("n_shared") == 0)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
