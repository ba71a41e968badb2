"""Image and object tables from a database or from any pair of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
               lower: int | None = None, upper: int | None = None, partitions: int = 1, **options) -> DataFrame:
    """JDBC scan in parallel ranges; filters and column lists reach the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", partitions))
    return reader.load()


def select_images(images: DataFrame, filters: dict[str, Sequence], columns: Sequence[str] | None = None) -> DataFrame:
    """AND over the filter columns of OR over their values (plain IN lists, so they push down)."""
    out = images
    for column, values in filters.items():
        out = out.filter(F.col(column).isin(list(values)))
    return out.select(*columns) if columns else out


def objects_of(objects: DataFrame, images: DataFrame, key: str = "image_id",
               columns: Sequence[str] | None = None) -> DataFrame:
    """Objects of the kept images: one equi-join instead of a query per image."""
    src = objects.select(key, *columns) if columns else objects
    return src.join(images.select(key), key, "left_semi")


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """Newline list, stripped, blanks ignored."""
    return spark.read.text(path).select(F.trim("value").alias("treatment")).filter("treatment <> ''").distinct()


def filter_treatments(images: DataFrame, names: DataFrame, column: str = "treatment") -> DataFrame:
    return images.join(names.withColumnRenamed("treatment", column), column, "left_semi")
