"""Cell, image and point views over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.config import FilterConfig, QcConfig

FEATURES = ("f1", "f2", "f3", "f4")
CONTROL = "N"

QC = QcConfig(
    position_x="f1", position_y="f1", cell_area="f2", nucleus_area="f2", ratio_area="f1", solidity="f3",
    min_dist_left=1, min_dist_right=1, min_dist_top=1, min_dist_bottom=1, image_width=51, image_height=51,
    min_nucleus_area=2000, max_nucleus_area=90000, min_area_fraction=500, max_area_fraction=5000,
    min_solidity=0.005, image_area=300000, min_cells=1, max_cells=3, min_background_area=50000)

FILTER = FilterConfig(features=("f1", "f2"), control_treatments=(CONTROL,), cutoff_threshold=1.0,
                      cutoff_fraction=0.9, mode=0, valid_only=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item. The six-column key is unique; ``seed_key`` feeds the seeded splits."""
    ship = F.year("l_shipdate") * 10000 + F.month("l_shipdate") * 100 + F.dayofmonth("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                    ship.cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("object_id"),
        (F.col("l_orderkey") * 48271 + F.col("l_linenumber") * 40692 + F.col("l_partkey") * 69621).alias("seed_key"),
        F.col("l_orderkey").alias("image_id"),
        F.col("l_returnflag").alias("treatment"),
        F.col("l_linestatus").alias("replicate"),
        (F.col("l_suppkey") % 12).alias("well"),
        (F.col("l_suppkey") % 4).alias("plate"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_quantity").alias("f1"),
        F.col("l_extendedprice").alias("f2"),
        F.col("l_discount").alias("f3"),
        F.col("l_tax").alias("f4"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.col("o_orderstatus").alias("treatment"),
        F.col("o_totalprice").alias("total_price"), F.col("o_orderpriority").alias("priority"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per embedding; label stands for the treatment, parity for the replicate."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("object_id"), F.col("label").alias("treatment"),
        (F.col("vec_id") % 2).alias("replicate"), F.col("embedding").cast("array<double>").alias("vec"))
