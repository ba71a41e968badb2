"""Control z-scores, intensity normalisation, feature selection and projections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.partials import partition_sums
from cellweave.functions.scalars import ieee_divide, is_finite, is_inf
from cellweave.functions.vectors import linear_map, vector
from cellweave.operators.masks import has_nan
from cellweave.operators.moments import moments


@dataclass(frozen=True)
class Scaling:
    """Mean and deviation per feature, and the features that survived."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    def column(self, i: int) -> Column:
        x, m, s = F.col(self.features[i]).cast("double"), self.mean[i], self.std[i]
        centred = x - F.lit(m)
        return centred / F.lit(s) if s != 0 else ieee_divide(centred, F.lit(0.0))

    def vector(self) -> Column:
        return F.array(*[self.column(i) for i in range(len(self.features))])

    def keep(self, names: Sequence[str]) -> "Scaling":
        at = [self.features.index(n) for n in names]
        return Scaling(tuple(names), tuple(self.mean[i] for i in at), tuple(self.std[i] for i in at))


def fit_scaling(controls: DataFrame, features: Sequence[str]) -> Scaling:
    """Mean and population deviation over control cells without NaN, in one aggregate."""
    clean = controls.filter(~has_nan(features))
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        aggs += [F.avg(x), F.stddev_pop(x)]
    row = clean.agg(*aggs).first()
    nan = float("nan")
    values = [nan if v is None else float(v) for v in row]
    return Scaling(tuple(features), tuple(values[0::2]), tuple(values[1::2]))


def normalise(cells: DataFrame, controls: DataFrame, features: Sequence[str],
              out: str = "vec") -> tuple[DataFrame, Scaling]:
    """z-score against controls; all-NaN and all-Inf features and then unfit cells drop out."""
    scaling = fit_scaling(controls, features)
    checks = []
    for i in range(len(features)):
        z = scaling.column(i)
        checks += [F.min(F.isnan(z)), F.min(is_inf(z) & ~F.isnan(z))]
    row = cells.agg(*checks).first()
    kept = [f for i, f in enumerate(features) if not (row[2 * i] or row[2 * i + 1])]
    scaling = scaling.keep(kept)
    good = F.lit(True)
    for i in range(len(kept)):
        good = good & is_finite(scaling.column(i))
    return cells.filter(good).withColumn(out, scaling.vector()), scaling


def control_means(cells: DataFrame, controls: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Mean of each intensity feature over valid control cells."""
    row = cells.filter(F.col("is_valid") & F.col("treatment").isin(list(controls))).agg(
        *[F.avg(F.col(f).cast("double")).alias(f) for f in features])
    return row.unpivot([], list(features), "feature", "mean_intensity")


def normalise_intensity(cells: DataFrame, controls: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Each feature divided by its mean over valid control cells."""
    means = {r["feature"]: r["mean_intensity"] for r in control_means(cells, controls, features).collect()}
    return cells.withColumns({
        f: ieee_divide(F.col(f).cast("double"), F.lit(float("nan") if means[f] is None else means[f]))
        for f in features})


def select_features(cells: DataFrame, features: Sequence[str], min_stddev: float = 0.01,
                    max_correlation: float = 0.9) -> dict[str, list[str]]:
    """Kept features and the three reject lists: NaN, low deviation, correlated with a later one."""
    row = cells.agg(
        *[F.max(F.isnan(F.col(f).cast("double"))) for f in features],
        *[F.stddev_pop(F.col(f).cast("double")) for f in features]).first()
    p = len(features)
    bad_nan = [f for i, f in enumerate(features) if row[i]]
    rest = [(f, row[p + i]) for i, f in enumerate(features) if not row[i]]
    bad_std = [f for f, s in rest if s is None or s <= min_stddev]
    left = [f for f, s in rest if f not in bad_std]
    corr = correlation(cells, left)
    bad_corr = [f for i, f in enumerate(left) if np.any(np.abs(corr[i, i + 1:]) > max_correlation)]
    return {"kept": [f for f in left if f not in bad_corr], "nan": bad_nan, "stddev": bad_std,
            "correlation": bad_corr}


def correlation(cells: DataFrame, features: Sequence[str]) -> np.ndarray:
    """Pearson correlation of all pairs, from one covariance matrix; NaN where a feature does not vary."""
    p = len(features)
    if p < 2:
        return np.eye(p)
    cov = moments(cells.select(vector(features).alias("_v")), "_v", p).cov
    sd = np.sqrt(np.diag(cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = cov / np.outer(sd, sd)
    np.fill_diagonal(out, 1.0)
    return out


def pca_projection(df: DataFrame, vec: str, n: int, out: str = "components") -> DataFrame:
    """Principal components of the centred points; each axis points to its largest positive loading."""
    p = len(df.select(vec).first()[0])
    mean = moments_mean(df, vec, p)
    centred = df.withColumn("_c", linear_map(F.col(vec), np.eye(p), mean))
    with_vec = centred.withColumn("_v", array_to_vector("_c"))
    model = PCA(k=n, inputCol="_v", outputCol="_pc").fit(with_vec)
    axes = model.pc.toArray()
    signs = np.sign(axes[np.argmax(np.abs(axes), axis=0), np.arange(axes.shape[1])])
    projected = model.transform(with_vec).withColumn("_pa", vector_to_array("_pc"))
    flipped = F.array(*[F.col("_pa")[i] * F.lit(float(signs[i])) for i in range(n)])
    return projected.withColumn(out, flipped).drop("_c", "_v", "_pc", "_pa")


def moments_mean(df: DataFrame, vec: str, p: int) -> np.ndarray:
    return np.array(list(df.agg(*[F.avg(F.col(vec)[i]) for i in range(p)]).first()), dtype=float)


def ica_model(df: DataFrame, vec: str, p: int, n: int, max_iter: int = 200,
              tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Independent components: whitening, then symmetric fixed-point rounds with g = tanh.

    Every round is one table-wide sum; only p×n matrices live on the driver.
    Returns (mean, p×n unmixing) with canonical order and signs.
    """
    m = moments(df, vec, p)
    lam, v = np.linalg.eigh(m.cov)
    top = np.argsort(lam)[::-1][:n]
    white = v[:, top] / np.sqrt(lam[top])
    mean = m.mean

    w = np.eye(n)
    for _ in range(max_iter):
        def kernel(x: np.ndarray, w=w) -> np.ndarray:
            z = (x - mean) @ white
            g = np.tanh(z @ w.T)
            return np.hstack([g.T @ z, (1.0 - g * g).sum(axis=0)[:, None]])

        s = partition_sums(df, vec, kernel, n, n + 1) / m.n
        new = s[:, :n] - s[:, n:] * w
        u, _, vt = np.linalg.svd(new)
        new = u @ vt
        done = np.max(np.abs(np.abs((new * w).sum(axis=1)) - 1.0)) < tol
        w = new
        if done:
            break
    unmix = white @ w.T
    signs = np.sign(unmix[np.argmax(np.abs(unmix), axis=0), np.arange(n)])
    unmix = unmix * signs
    order = np.argsort(-np.abs(unmix).max(axis=0), kind="stable")
    return mean, unmix[:, order]


def ica_projection(df: DataFrame, vec: str, p: int, n: int = 3, out: str = "components", **kw) -> DataFrame:
    mean, unmix = ica_model(df, vec, p, n, **kw)
    return df.withColumn(out, linear_map(F.col(vec), unmix, mean))


def append_components(cells: DataFrame, components: str, n: int, valid: str = "is_valid") -> DataFrame:
    """'PCA i' feature columns; invalid cells hold ∞."""
    return cells.withColumns({
        f"PCA {i + 1}": F.when(F.col(valid), F.col(components)[i]).otherwise(F.lit(float("inf"))) for i in range(n)})


