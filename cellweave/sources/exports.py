"""Text exports of heatmaps and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heatmap_lines(heatmap: DataFrame, title: str, labels: Sequence[str], value: str = "distance") -> DataFrame:
    """(line_no, line): title, tab header of labels, one row per group with ``%f`` values.

    Each row is assembled from its own group, so the matrix never sits in one task.
    """
    order = F.create_map(*[F.lit(x) for i, g in enumerate(labels) for x in (g, i)])
    cells = heatmap.select(
        F.try_element_at(order, F.col("row_group")).alias("_r"), F.col("row_group"),
        F.struct(F.try_element_at(order, F.col("col_group")).alias("c"), F.format_string("%f", F.col(value)).alias("t")).alias("e"))
    rows = cells.groupBy("_r", "row_group").agg(F.sort_array(F.collect_list("e")).alias("es"))
    body = rows.select((F.col("_r") + 2).cast("int").alias("line_no"),
                       F.concat_ws("\t", F.col("row_group"), F.concat_ws("\t", F.col("es.t"))).alias("line"))
    head = heatmap.sparkSession.createDataFrame(
        [(0, title), (1, "\t" + "\t".join(labels))], "line_no int, line string")
    return head.union(body)


def feature_lines(cells: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    """(object, line): index and ``%f`` per feature, tab separated."""
    values = [F.format_string("%f", F.col(f).cast("double")) for f in features]
    return cells.select(F.col(id_col), F.concat_ws("\t", F.col(id_col).cast("string"), *values).alias("line"))


def write_heatmap(heatmap: DataFrame, path: str, title: str, labels: Sequence[str], value: str = "distance") -> None:
    heatmap_lines(heatmap, title, labels, value).orderBy("line_no").select("line").coalesce(1).write.mode(
        "overwrite").text(path)


def write_features(cells: DataFrame, path: str, id_col: str, features: Sequence[str]) -> None:
    """Header directory and one text file per partition."""
    spark = cells.sparkSession
    header = [("\t".join(["", *[str(i) for i in range(len(features))]]),), ("\t".join(["", *features]),)]
    spark.createDataFrame(header, "line string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    feature_lines(cells, id_col, features).select("line").write.mode("overwrite").text(f"{path}/rows")
