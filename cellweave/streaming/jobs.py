"""Streaming quality control, scoring and running populations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.config import QcConfig
from cellweave.functions.vectors import centroid_distances, nearest
from cellweave.operators.normalize import Scaling
from cellweave.operators.quality import with_cell_codes


def stream_quality(cells: DataFrame, cfg: QcConfig) -> DataFrame:
    """Cell codes of arriving cells: stateless, append mode."""
    return with_cell_codes(cells, cfg)


def stream_scores(cells: DataFrame, scaling: Scaling, centroids: np.ndarray, p: float = 2) -> DataFrame:
    """z-score and nearest centroid under a saved model: stateless, the model travels as literals."""
    scored = cells.withColumn("vec", scaling.vector())
    scored = scored.withColumn("dist", centroid_distances(F.col("vec"), centroids, p))
    return scored.withColumn("cluster", nearest(F.col("dist")))


def running_population(cells: DataFrame, by: str = "treatment", flag: str = "is_non_control") -> DataFrame:
    """Cells, non-control cells and penetrance per treatment: update or complete mode, one state row per treatment."""
    non_control = F.sum(F.col(flag).cast("bigint"))
    return cells.groupBy(by).agg(
        F.count("*").alias("n_valid"), non_control.alias("n_non_control"),
        (non_control / F.count("*")).alias("penetrance"))


def windowed_population(cells: DataFrame, time: str = "ts", by: str = "treatment", window: str = "1 day",
                        late: str = "1 hour") -> DataFrame:
    """Population per tumbling event-time window; state is dropped once the watermark has passed."""
    return cells.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), by).agg(
        F.count("*").alias("n_cells"), F.sum("value").alias("total"))


def drain_to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived, then stop. Complete mode rewrites the result each batch."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", path).start()
    else:
        query = writer.outputMode(mode).foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
