"""Control-like cells by trimmed Mahalanobis distance to the control treatments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from cellweave.config import FilterConfig
from cellweave.functions.vectors import quadratic_form, vector
from cellweave.operators.moments import Moments, inverse_covariance, moments
from cellweave.operators.order_stats import distributed_rank, median_and_mad, order_statistics


@dataclass(frozen=True)
class MahalanobisModel:
    mean: np.ndarray
    inverse: np.ndarray
    n_reference: int

    def squared(self, vec: Column) -> Column:
        return quadratic_form(vec, self.mean, self.inverse)


def kept_rows(n: int, fraction: float) -> int:
    """Rows of the reference that survive trimming (half rounds to even)."""
    return min(n, int(np.round(n * fraction)) + 1)


def _as_model(m: Moments) -> MahalanobisModel:
    return MahalanobisModel(m.mean, inverse_covariance(m.cov), m.n)


def fit_mahalanobis(reference: DataFrame, vec: str, p: int, fraction: float = 0.8,
                    id_col: str = "object_id") -> MahalanobisModel:
    """Trimmed reference moments: rank the rows by their own distance, keep the best part, refit.

    The rank cut is an exact order statistic; rows tied at the cut are taken in id order.
    """
    first = _as_model(moments(reference, vec, p))
    if fraction >= 1.0:
        return first
    keep = kept_rows(first.n_reference, fraction)
    if keep >= first.n_reference:
        return first
    scored = reference.select(id_col, vec, first.squared(F.col(vec)).alias("_d"))
    cut = order_statistics(scored, [], "_d", fraction, {"cut": lambda n: F.lit(keep - 1)}).first()["cut"]
    below, ties = F.col("_d") < F.lit(cut), F.col("_d") == F.lit(cut)
    counts = scored.agg(F.sum(below.cast("bigint")), F.sum(ties.cast("bigint"))).first()
    if counts[0] + counts[1] == keep:
        trimmed = scored.filter(below | ties)
    else:
        ranked = distributed_rank(scored.filter(ties), [id_col])
        trimmed = scored.filter(below).union(
            ranked.filter(F.col("position") <= keep - counts[0]).select(*scored.columns))
    return _as_model(moments(trimmed, vec, p))


def mahalanobis_squared(reference: DataFrame, test: DataFrame, vec: str, p: int, fraction: float = 0.8,
                        id_col: str = "object_id", out: str = "mahal_squared") -> DataFrame:
    model = fit_mahalanobis(reference, vec, p, fraction, id_col)
    return test.withColumn(out, model.squared(F.col(vec)))


@dataclass(frozen=True)
class ControlSplit:
    cells: DataFrame
    model: MahalanobisModel | None
    lower: float
    upper: float
    median: float | None
    mad: float | None


def _flags(cells: DataFrame, lower: float, upper: float) -> DataFrame:
    d = F.col("mahal_dist")
    outside = ((d > F.lit(upper)) & ~F.isnan(d)) | (d < F.lit(lower))
    return cells.withColumns({
        "is_control_like": F.col("is_valid") & ~outside,
        "is_non_control": F.col("is_valid") & outside,
    })


def split_controls(cells: DataFrame, cfg: FilterConfig, id_col: str = "object_id",
                   vec: Column | None = None) -> ControlSplit:
    """Distance of valid cells to the controls (∞ if invalid), cutoffs and both flags.

    ``vec`` replaces the feature vector, e.g. by its component projection.
    Only moments and cutoffs leave the executors.
    """
    if not cfg.run_mahal_dist or not cfg.features:
        none = cells.withColumns({
            "mahal_dist": F.lit(float("nan")), "is_control_like": F.lit(False),
            "is_non_control": F.col("is_valid")})
        return ControlSplit(none, None, 0.0, 0.0, None, None)
    p = len(cfg.features)
    point = vector(cfg.features) if vec is None else vec
    control = F.col("treatment").isin(list(cfg.control_treatments))
    reference = cells.filter(F.col("is_valid") & control).select(id_col, point.alias("_vec"))
    # about ten passes over the controls follow: keep their points, spilling to disk
    reference = reference.persist(StorageLevel.MEMORY_AND_DISK)
    model = fit_mahalanobis(reference, "_vec", p, cfg.cutoff_fraction, id_col)
    scored = cells.withColumn(
        "mahal_dist",
        F.when(F.col("is_valid"), F.sqrt(model.squared(point))).otherwise(F.lit(float("inf"))))
    if cfg.valid_only:
        chosen = reference.select(F.lit(True).alias("is_valid"),
                                  F.sqrt(model.squared(F.col("_vec"))).alias("mahal_dist"))
    else:
        chosen = scored.filter(control).select("is_valid", "mahal_dist")
    chosen = chosen.persist(StorageLevel.MEMORY_AND_DISK)
    stats = median_and_mad(chosen, [], "mahal_dist").first()
    med, mad = stats["median"], stats["mad"]
    c = cfg.cutoff_threshold
    upper = med + c * mad if cfg.mode in (0, 2) else c * med
    if cfg.mode in (2, 3) and c >= 0.0:
        d = F.col("mahal_dist")
        row = chosen.agg(
            F.count("*"), F.sum((F.col("is_valid") & (d > F.lit(float(upper)))).cast("bigint"))).first()
        if row[1] / row[0] > 0.1:
            index = min(int(0.9 * row[0] + 1), row[0] - 1)
            upper = order_statistics(chosen, [], "mahal_dist", 0.9, {"v": lambda n: F.lit(index)}).first()["v"]
    chosen.unpersist()
    reference.unpersist()
    return ControlSplit(_flags(scored, 0.0, float(upper)), model, 0.0, float(upper), med, mad)
