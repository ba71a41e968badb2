"""Threshold quality control of cells and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave import model as M
from cellweave.config import QcConfig
from cellweave.functions.scalars import above, label_of


def cell_code(cfg: QcConfig) -> Column:
    """Code of the first failing rule, 1 if none fails. All rules are strict and fail on NaN."""
    def col(name: str) -> Column:
        return F.col(name).cast("double")

    def lit(x: float) -> Column:
        return F.lit(float(x))

    x, y = col(cfg.position_x), col(cfg.position_y)
    nucleus, cell = col(cfg.nucleus_area), col(cfg.cell_area)
    ratio = col(cfg.ratio_area or cfg.nucleus_area)
    inside = (
        above(x, lit(cfg.min_dist_left)) & above(lit(cfg.image_width - cfg.min_dist_right), x)
        & above(y, lit(cfg.min_dist_top)) & above(lit(cfg.image_height - cfg.min_dist_bottom), y)
    )
    return (
        F.when(~inside, M.QC_OUT_OF_PERIPHERY)
        .when(~above(nucleus, lit(cfg.min_nucleus_area)), M.QC_TOO_SMALL_NUCLEUS)
        .when(~above(lit(cfg.max_nucleus_area), nucleus), M.QC_TOO_BIG_NUCLEUS)
        .when(~above(cell, lit(cfg.min_area_fraction) * ratio), M.QC_TOO_SMALL_CYTOPLASM)
        .when(~above(lit(cfg.max_area_fraction) * ratio, cell), M.QC_TOO_BIG_CYTOPLASM)
        .when(~above(col(cfg.solidity), lit(cfg.min_solidity)), M.QC_TOO_SMALL_NUCLEUS_SOLIDITY)
        .otherwise(M.QC_VALID)
    )


def with_cell_codes(objects: DataFrame, cfg: QcConfig) -> DataFrame:
    """Map-only: a chain of comparisons on the scan."""
    return objects.withColumn("qc_code", cell_code(cfg))


def image_codes(images: DataFrame, coded: DataFrame, cfg: QcConfig) -> DataFrame:
    """Code per image; images without any cell fail for lack of valid cells.

    Cells are summed per image before the join, with partial sums on the map
    side, so an image with very many cells costs one row per task.
    """
    per_image = coded.groupBy("image_id").agg(
        F.sum((F.col("qc_code") == M.QC_VALID).cast("bigint")).alias("n_valid"),
        F.sum(cfg.cell_area).alias("cell_area"),
    )
    joined = images.select("image_id").join(per_image, "image_id", "left").select(
        "image_id", F.coalesce("n_valid", F.lit(0)).cast("bigint").alias("n_valid"),
        F.coalesce("cell_area", F.lit(0.0)).alias("cell_area"))
    area = cfg.image_width * cfg.image_height if cfg.image_area is None else cfg.image_area
    background = F.lit(float(area)) - F.col("cell_area")
    return joined.withColumn(
        "image_code",
        F.when(F.col("n_valid") < cfg.min_cells, M.QC_NOT_ENOUGH_VALID_CELLS)
        .when(F.col("n_valid") > cfg.max_cells, M.QC_TOO_MANY_CELLS)
        .when(background < float(cfg.min_background_area), M.QC_NOT_ENOUGH_BG_PIXELS)
        .otherwise(M.QC_DEFAULT),
    )


def with_validity(coded: DataFrame, image_qc: DataFrame) -> DataFrame:
    """A cell is valid if it and its image passed; its own code is kept as it is."""
    flags = image_qc.select("image_id", "image_code")
    return coded.join(flags, "image_id").withColumn(
        "is_valid", (F.col("qc_code") == M.QC_VALID) & (F.col("image_code") == M.QC_DEFAULT))


def run_quality_control(objects: DataFrame, images: DataFrame, cfg: QcConfig) -> DataFrame:
    coded = with_cell_codes(objects, cfg)
    return with_validity(coded, image_codes(images, coded, cfg))


def image_summary(image_qc: DataFrame) -> DataFrame:
    """Per image state: images and the cells that had passed their own rules."""
    return image_qc.groupBy("image_code").agg(
        F.count("*").alias("n_images"), F.sum("n_valid").alias("n_valid_cells"))


def code_counts(coded: DataFrame) -> DataFrame:
    return coded.groupBy("qc_code").agg(F.count("*").alias("n_cells"))


def with_code_text(df: DataFrame, code: str = "qc_code") -> DataFrame:
    return df.withColumn("qc_text", label_of(F.col(code), M.QC_TEXT))
