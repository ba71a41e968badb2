"""Datasets, models and stage states as directories of Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions.scalars import rename_wild_type
from cellweave.operators.normalize import Scaling

VERSION = "0.5"
# Container versions a reader accepts.
SUPPORTED_VERSIONS = ("0.1", "0.2", "0.3", "0.4", "0.5")


def save_dataset(tables: dict[str, DataFrame], path: str, features: Sequence[str], version: str = VERSION) -> None:
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(version, list(features), sorted(tables))],
                          "version string, features array<string>, tables array<string>").write.mode(
        "overwrite").parquet(f"{path}/manifest")


def load_dataset(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], list[str]]:
    manifest = spark.read.parquet(f"{path}/manifest").first()
    if manifest["version"] not in SUPPORTED_VERSIONS:
        raise ValueError(f"unsupported dataset version {manifest['version']}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in manifest["tables"]}, list(manifest["features"])


def merge_datasets(parts: Sequence[DataFrame], features: Sequence[str],
                   dimensions: Sequence[str] = ("treatment", "replicate", "well")) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Union on the columns of the first dataset, names unified, dimensions re-indexed.

    A missing feature is an error, extra columns are dropped. Treatments that
    start with ``wt`` are renamed, an empty replicate becomes the dataset
    number. Equal names collapse to the index of their first dataset. Each
    dimension is numbered over its distinct names only.
    """
    columns = parts[0].columns
    aligned = []
    for number, part in enumerate(parts):
        missing = [c for c in columns if c not in part.columns]
        if missing:
            raise ValueError(f"dataset {number} lacks columns {missing}")
        df = part.select(*columns).withColumn("dataset_no", F.lit(number))
        if "treatment" in dimensions:
            df = df.withColumn("treatment", rename_wild_type(F.col("treatment")))
        if "replicate" in dimensions:
            df = df.withColumn("replicate", F.when(F.trim(F.col("replicate").cast("string")) == "", F.lit(str(number)))
                               .otherwise(F.col("replicate").cast("string")))
        aligned.append(df)
    merged = reduce(lambda a, b: a.unionByName(b), aligned)
    tables = {}
    for d in dimensions:
        names = merged.groupBy(d).agg(F.min("dataset_no").alias("first_dataset"))
        order = Window.orderBy("first_dataset", d)
        tables[d] = names.select(d, (F.row_number().over(order) - 1).alias(f"{d}_index"))
        # a missing name is a name of its own
        index = tables[d].withColumnRenamed(d, "_name")
        merged = merged.join(index, merged[d].eqNullSafe(index["_name"])).drop("_name")
    return merged, tables


def save_model(spark: SparkSession, path: str, centroids: np.ndarray, scaling: Scaling, params: dict[str, str],
               sizes: Sequence[int] | None = None, tree: Sequence[tuple] | None = None) -> None:
    """Model directory: centroids, scaling, params and, for tree methods, nodes."""
    sizes = [0] * len(centroids) if sizes is None else list(sizes)
    spark.createDataFrame([(i, [float(x) for x in c], int(n)) for i, (c, n) in enumerate(zip(centroids, sizes))],
                          "cluster int, centroid array<double>, size bigint").write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([(i, f, float(m), float(s)) for i, (f, m, s) in enumerate(
        zip(scaling.features, scaling.mean, scaling.std))], "position int, feature string, mean double, std double"
    ).write.mode("overwrite").parquet(f"{path}/scaling")
    spark.createDataFrame([(k, str(v)) for k, v in params.items()], "name string, value string").write.mode(
        "overwrite").parquet(f"{path}/params")
    if tree is not None:
        spark.createDataFrame(list(tree), "node int, dim int, value double, left int, right int, leaf int").write.mode(
            "overwrite").parquet(f"{path}/tree")


def load_model(spark: SparkSession, path: str) -> tuple[np.ndarray, Scaling, dict[str, str]]:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cluster").collect()
    scale = spark.read.parquet(f"{path}/scaling").orderBy("position").collect()
    params = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/params").collect()}
    return (np.array([r["centroid"] for r in rows]),
            Scaling(tuple(r["feature"] for r in scale), tuple(r["mean"] for r in scale), tuple(r["std"] for r in scale)),
            params)


def load_tree(spark: SparkSession, path: str) -> list[tuple]:
    return [tuple(r) for r in spark.read.parquet(f"{path}/tree").orderBy("node").collect()]


def save_state(stages: dict[str, DataFrame], path: str) -> None:
    """One table per finished stage; a restarted job resumes from the last one."""
    for name, df in stages.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_state(spark: SparkSession, path: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{stage}")
