"""Vector expressions over ``array<double>`` columns and small driver-side models."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions.partials import list_matrix, matrix_list
from cellweave.functions.scalars import ieee_divide
from cellweave.model import UNROLL_TERMS, check_model_size


def vector(names: Sequence[str]) -> Column:
    """Feature columns as one array, the point representation of every clustering operator."""
    return F.array(*[F.col(n).cast("double") for n in names])


def literal_array(values: Sequence[float]) -> Column:
    """Array literal parsed once at planning time (constant-folded), not element by element."""
    check_model_size(len(values), "array literal")
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def literal_matrix(m: np.ndarray) -> Column:
    m = np.asarray(m, dtype=float)
    check_model_size(m.size, "matrix literal")
    return F.from_json(F.lit(json.dumps(m.tolist())), "array<array<double>>")


def total(terms: Sequence[Column]) -> Column:
    """Balanced sum, so that long sums do not nest deeply."""
    terms = list(terms)
    if not terms:
        return F.lit(0.0)
    while len(terms) > 1:
        paired = [a + b for a, b in zip(terms[::2], terms[1::2])]
        terms = paired + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def root(x: Column, p: float) -> Column:
    if p == 1:
        return x
    return F.sqrt(x) if p == 2 else F.pow(x, F.lit(1.0 / p))


def power(x: Column, p: float) -> Column:
    if p == 1:
        return F.abs(x)
    return x * x if p == 2 else F.pow(F.abs(x), F.lit(float(p)))


def minkowski(a: Column, b: Column, p: float = 2, weights: Column | None = None) -> Column:
    """Minkowski distance of two array columns; weights multiply both sides."""
    diff = F.zip_with(a, b, lambda x, y: x - y)
    if weights is not None:
        diff = F.zip_with(diff, weights, lambda d, w: d * w)
    return root(F.aggregate(diff, F.lit(0.0), lambda acc, d: acc + power(d, p)), p)


#: Doubles a batch kernel holds at once.
KERNEL_VALUES = 2_000_000


def balanced_sum(terms: np.ndarray) -> np.ndarray:
    """Sum over the last axis in the order of ``total``, so both give the same bits."""
    while terms.shape[-1] > 1:
        even = terms.shape[-1] // 2 * 2
        paired = terms[..., 0:even:2] + terms[..., 1:even:2]
        terms = paired if even == terms.shape[-1] else np.concatenate([paired, terms[..., even:]], axis=-1)
    return terms[..., 0] if terms.shape[-1] else np.zeros(terms.shape[:-1])


def row_blocks(rows: int, values_per_row: int) -> list[slice]:
    step = max(1, KERNEL_VALUES // max(values_per_row, 1))
    return [slice(i, i + step) for i in range(0, rows, step)]


def distance_matrix(points: np.ndarray, centroids: np.ndarray, p: float = 2,
                    weights: np.ndarray | None = None) -> np.ndarray:
    """Batch kernel: rows × centroids, always from true differences. Runs inside tasks on one Arrow batch at a time."""
    k, n = centroids.shape
    out = np.empty((len(points), k))
    for rows in row_blocks(len(points), k * n):
        d = points[rows, None, :] - centroids[None]
        if weights is not None:
            d *= weights
        if p == 2:
            out[rows] = np.sqrt(balanced_sum(d * d))
        else:
            d = np.abs(d)
            out[rows] = balanced_sum(d) if p == 1 else balanced_sum(d ** p) ** (1.0 / p)
    return out


def nearest_rows(points: np.ndarray, centroids: np.ndarray, p: float = 2,
                 weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of the nearest centroid of each row: the same answer as the least of ``distance_matrix``.

    For Euclidean distances one matrix product finds the candidates, those that rounding cannot tell from the least;
    their distances come from true differences, and ties go to the lowest index.
    """
    if p != 2 or (weights is not None and np.ndim(weights) == 2) or not len(points):
        d = distance_matrix(points, centroids, p, weights)
        best = d.argmin(axis=1)
        return best, d[np.arange(len(points)), best]
    a, b = (points, centroids) if weights is None else (points * weights, centroids * weights)
    shift = b.mean(axis=0)
    a, b = a - shift, b - shift
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    sq = a @ (-2.0 * b.T) + nb[None, :]  # less the square of the point, which changes no order
    slack = 1e-12 * (na + nb.max()) * max(points.shape[1], 1)
    best = sq.argmin(axis=1)
    least = sq[np.arange(len(sq)), best]
    close = np.flatnonzero(np.count_nonzero(sq <= (least + slack)[:, None], axis=1) > 1)
    if len(close):
        d = distance_matrix(points[close], centroids, p, weights)
        best[close] = np.where(sq[close] <= (least + slack)[close, None], d, np.inf).argmin(axis=1)
    d = points - centroids[best]
    if weights is not None:
        d = d * weights
    return best, np.sqrt(balanced_sum(d * d))


def centroid_distances(vec: Column, centroids: np.ndarray, p: float = 2,
                       weights: np.ndarray | None = None) -> Column:
    """array<double> of the distance to each centroid.

    Few terms become generated code; many terms become a kernel per Arrow batch
    that adds up the same differences in the same order. Nothing is joined or shuffled either way. ``weights`` has one
    entry per feature, or one row per centroid.
    """
    c = np.asarray(centroids, dtype=float)
    check_model_size(c.size, "centroids")
    w = None if weights is None else np.asarray(weights, dtype=float)
    if c.size <= UNROLL_TERMS:
        per_centroid = []
        for k in range(c.shape[0]):
            wk = None if w is None else (w if w.ndim == 1 else w[k])
            terms = []
            for i in range(c.shape[1]):
                diff = vec[i] - F.lit(float(c[k, i]))
                terms.append(power(diff if wk is None else diff * F.lit(float(wk[i])), p))
            per_centroid.append(root(total(terms), p))
        return F.array(*per_centroid)

    @F.arrow_udf("array<double>")
    def distances(v: pa.Array) -> pa.Array:
        x = list_matrix(v).reshape(-1, c.shape[1])
        return matrix_list(distance_matrix(x, c, p, w))

    return distances(vec)


def nearest(distances: Column) -> Column:
    """Index of the smallest entry; ties go to the lowest index."""
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def quadratic_form(vec: Column, mean: np.ndarray, inverse: np.ndarray) -> Column:
    """(x − μ) Σ⁻¹ (x − μ)ᵀ under a driver-side mean and inverse covariance."""
    mean = np.asarray(mean, dtype=float)
    inverse = np.asarray(inverse, dtype=float)
    n = len(mean)
    check_model_size(inverse.size, "inverse covariance")
    if n * n <= UNROLL_TERMS:
        x = [vec[i] - F.lit(float(mean[i])) for i in range(n)]
        terms = [x[i] * x[i] * F.lit(float(inverse[i, i])) for i in range(n)]
        terms += [x[i] * x[j] * F.lit(float(inverse[i, j] + inverse[j, i]))
                  for i in range(n) for j in range(i + 1, n)]
        return total(terms)

    @F.arrow_udf("double")
    def form(v: pa.Array) -> pa.Array:
        return pa.array(quadratic_rows(list_matrix(v).reshape(-1, n), mean, inverse))

    return form(vec)


def quadratic_rows(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """The same for the rows of a matrix; equal rows give equal bits wherever they stand."""
    n = len(mean)
    i, j = np.triu_indices(n, 1)
    cross = inverse[i, j] + inverse[j, i]
    out = np.empty(len(x))
    for rows in row_blocks(len(x), n * (n + 1) // 2):
        y = x[rows] - mean
        out[rows] = balanced_sum(np.hstack([y * y * np.diag(inverse), y[:, i] * y[:, j] * cross]))
    return out


def linear_map(vec: Column, matrix: np.ndarray, shift: np.ndarray | None = None) -> Column:
    """Row vector times ``matrix`` after subtracting ``shift``."""
    m = np.asarray(matrix, dtype=float)
    check_model_size(m.size, "transform")
    s = np.zeros(m.shape[0]) if shift is None else np.asarray(shift, dtype=float)
    if m.size <= UNROLL_TERMS:
        x = [vec[i] - F.lit(float(s[i])) for i in range(m.shape[0])]
        return F.array(*[total([x[i] * F.lit(float(m[i, j])) for i in range(m.shape[0])])
                         for j in range(m.shape[1])])

    @F.arrow_udf("array<double>")
    def apply(v: pa.Array) -> pa.Array:
        x = list_matrix(v).reshape(-1, m.shape[0]) - s
        out = np.empty((len(x), m.shape[1]))
        for rows in row_blocks(len(x), m.size):
            out[rows] = balanced_sum(x[rows, None, :] * m.T[None])
        return matrix_list(out)

    return apply(vec)


def normalised(a: Column) -> Column:
    """Array scaled to sum 1 (0/0 = NaN as in floating point)."""
    s = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(a, lambda x: ieee_divide(x, s))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def element_sums(vec: Column, n: int, name: str = "s") -> list[Column]:
    """Aggregates sum(vec[i]) for every position: partial sums combine before the shuffle."""
    return [F.sum(vec[i]).alias(f"{name}{i}") for i in range(n)]


def element_means(vec: Column, n: int) -> Column:
    return F.array(*[F.avg(vec[i]) for i in range(n)])
