"""Moments, covariances and the transforms built on them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions.partials import list_matrix, partition_sums
from cellweave.functions.vectors import linear_map, quadratic_rows
from cellweave.model import MAX_MODEL_VALUES, check_model_size
from cellweave.operators.order_stats import distributed_rank
from cellweave.session import cut_lineage


@dataclass(frozen=True)
class Moments:
    n: int
    mean: np.ndarray
    cov: np.ndarray


def moments(df: DataFrame, vec: str, p: int) -> Moments:
    """Count, mean and 1/N covariance: one Gram matrix of the centred rows per partition, added up."""
    check_model_size(p * p, "covariance")
    row = df.agg(F.count("*"), *[F.avg(F.col(vec)[i]) for i in range(p)]).first()
    n, mean = row[0], np.array([np.nan if x is None else x for x in row[1:]], dtype=float)
    cov = np.full((p, p), np.nan)
    if n == 0:
        return Moments(0, mean, cov)
    gram = partition_sums(df, vec, lambda m: (m[:, :p] - mean).T @ (m[:, :p] - mean), p, p)
    # the two halves of a matrix product may differ in the last bit
    cov = (gram + gram.T) / (2 * n)
    return Moments(n, mean, cov)


#: Doubles of group moments a task holds before it sends them on.
HELD_VALUES = 4_000_000


class _Gram:
    """Count, mean and centred Gram matrix, merged without cancellation."""

    def __init__(self, n: int, mean: np.ndarray, gram: np.ndarray):
        self.n, self.mean, self.gram = n, mean, gram

    @staticmethod
    def of(x: np.ndarray) -> "_Gram":
        mean = x.mean(axis=0)
        y = x - mean
        return _Gram(len(x), mean, y.T @ y)

    def add(self, other: "_Gram") -> None:
        n = self.n + other.n
        gap = other.mean - self.mean
        self.gram = self.gram + other.gram + np.outer(gap, gap) * (self.n * other.n / n)
        self.mean = self.mean + gap * (other.n / n)
        self.n = n


def grouped_moments(df: DataFrame, keys: Sequence[str], vec: str, p: int) -> DataFrame:
    """Per group: n, mean array and flattened p×p covariance (1/N), in one pass.

    Each task sums one block (n, mean, Gram matrix) per group it sees, so a group with a third of the rows is one block a
    task; blocks of a group are merged one after another. Rows without a vector take no part.
    """
    keys = list(keys)
    check_model_size(p * p, "covariance of a group")
    kinds = T.StructType([df.schema[k] for k in keys])
    schema = T.StructType([*kinds.fields, T.StructField("n", T.LongType()), T.StructField("mean", T.ArrayType(T.DoubleType())),
                           T.StructField("cov", T.ArrayType(T.DoubleType()))])

    def rows_of(held: dict[tuple, _Gram], types: list[pa.DataType], final: bool) -> pa.RecordBatch:
        grams = [g.gram / g.n if final else g.gram for g in held.values()]
        grams = [(m + m.T) / 2 for m in grams]  # the two halves of a product may differ in the last bit
        return pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in held], type=t) for i, t in enumerate(types)), pa.array([g.n for g in held.values()], pa.int64()),
             pa.array([g.mean.tolist() for g in held.values()], pa.list_(pa.float64())), pa.array([m.ravel().tolist() for m in grams], pa.list_(pa.float64()))],
            names=[*keys, "n", "mean", "cov"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Gram] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.column(k).type for k in keys]
            x = list_matrix(batch.column(vec)).reshape(batch.num_rows, -1)[:, :p].astype(float)
            code = np.zeros(batch.num_rows, dtype=np.int64)
            for k in keys:
                own = batch.column(k).dictionary_encode(null_encoding="encode")
                code = np.unique(code * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            first = np.append(np.flatnonzero(np.diff(code[order], prepend=-1)), len(order))
            for s, e in zip(first, first[1:]):
                key = tuple(batch.column(k)[int(order[s])].as_py() for k in keys)
                block = _Gram.of(x[order[s:e]])
                if key in held:
                    held[key].add(block)
                else:
                    held[key] = block
            if len(held) * p * p > HELD_VALUES:
                yield rows_of(held, types, False)
                held = {}
        if held:
            yield rows_of(held, types, False)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, types = None, None, []
        for batch in batches:
            types = [batch.column(k).type for k in keys]
            for i in range(batch.num_rows):
                own = tuple(batch.column(k)[i].as_py() for k in keys)
                block = _Gram(batch.column("n")[i].as_py(), np.array(batch.column("mean")[i].as_py()), np.array(batch.column("cov")[i].as_py()).reshape(p, p))
                if now is not None and own == key:
                    now.add(block)
                    continue
                if now is not None:
                    yield rows_of({key: now}, types, True)
                key, now = own, block
        if now is not None:
            yield rows_of({key: now}, types, True)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = df.filter(F.col(vec).isNotNull()).select(*keys, vec).mapInArrow(summed, schema)
    return blocks.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(merged, schema)


def covariance_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Covariance with 1/N in long form from one Gram matrix; a row with a NULL feature takes no part."""
    names = list(features)
    whole = df.filter(" AND ".join(f"`{f}` IS NOT NULL" for f in names)).select(
        F.array(*[F.col(f).cast("double") for f in names]).alias("vec"))
    cov = moments(whole, "vec", len(names)).cov
    return df.sparkSession.createDataFrame(
        [(a, b, float(cov[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "feature_i string, feature_j string, covariance double")


def group_models(groups: DataFrame, p: int) -> Iterator[dict]:
    """Means and inverses by group (column g), a bounded number at a time; groups with a singular covariance have None."""
    step = max(1, MAX_MODEL_VALUES // (4 * p * p))
    ranked = cut_lineage(distributed_rank(groups.select("g", "mean", "inverse"), ["g"], name="_no"))
    for lo in range(0, ranked.count(), step):
        rows = ranked.filter((F.col("_no") > lo) & (F.col("_no") <= lo + step)).collect()
        yield {r["g"]: None if r["inverse"] is None else (np.array(r["mean"]), np.array(r["inverse"]).reshape(p, p)) for r in rows}


def own_group_forms(rows: DataFrame, groups: DataFrame, vec: str, p: int, out: str) -> DataFrame:
    """Adds the quadratic form of each row under the mean and inverse of its group g; NULL where that is singular.

    The models go to the rows, a bounded number of groups in each pass; rows are neither joined nor shuffled.
    """
    parts = None
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    for models in group_models(groups, p):
        shared = rows.sparkSession.sparkContext.broadcast(models)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column("g").dictionary_encode()
                code, x = own.indices.to_numpy(zero_copy_only=False), list_matrix(batch.column(vec)).reshape(batch.num_rows, -1)[:, :p]
                value, some = np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=bool)
                keep = np.zeros(batch.num_rows, dtype=bool)
                for k, name in enumerate(own.dictionary.to_pylist()):
                    if name in shared.value:
                        at = np.flatnonzero(code == k)
                        keep[at] = True
                        if shared.value[name] is not None:
                            value[at], some[at] = quadratic_rows(x[at], *shared.value[name]), True
                done = pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, mask=~some)], names=[*batch.schema.names, out])
                yield done.filter(pa.array(keep))

        part = rows.mapInArrow(run, schema)
        parts = part if parts is None else parts.union(part)
    return rows.withColumn(out, F.lit(None).cast("double")).limit(0) if parts is None else parts


def mean_forms(reference: DataFrame, tests: DataFrame, p: int) -> DataFrame:
    """(row_group, col_group, distance): mean quadratic form of the members of each test group under each reference group.

    It follows from the test group's mean and covariance: tr(Σi⁻¹ Cj) + (mj − mi) Σi⁻¹ (mj − mi). References go to the tests.
    """
    out = None
    for models in group_models(reference, p):
        shared = tests.sparkSession.sparkContext.broadcast(models)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names = list(shared.value)
            good = [k for k in names if shared.value[k] is not None]
            means = np.array([shared.value[k][0] for k in good]).reshape(-1, p)
            inverses = np.array([shared.value[k][1] for k in good]).reshape(-1, p, p)
            for batch in batches:
                mean, cov = (list_matrix(batch.column(c)).reshape(batch.num_rows, -1) for c in ("mean", "cov"))
                for i, col in enumerate(batch.column("g").to_pylist()):
                    gap = mean[i] - means
                    value = inverses.reshape(len(good), -1) @ cov[i] + np.einsum("gi,gij,gj->g", gap, inverses, gap)
                    far = dict(zip(good, value.tolist()))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([col] * len(names), pa.string()),
                                                      pa.array([far.get(k) for k in names], pa.float64())], names=["row_group", "col_group", "distance"])

        part = tests.select("g", "mean", "cov").mapInArrow(run, "row_group string, col_group string, distance double")
        out = part if out is None else out.union(part)
    return tests.sparkSession.createDataFrame([], "row_group string, col_group string, distance double") if out is None else out


def inverse_covariance(cov: np.ndarray) -> np.ndarray:
    """Inverse of a p×p matrix: by Cholesky when positive definite, else a general solve."""
    try:
        low = np.linalg.inv(np.linalg.cholesky(cov))
        return low.T @ low
    except np.linalg.LinAlgError:
        return np.linalg.inv(cov)


def with_group_inverse(groups: DataFrame, p: int) -> DataFrame:
    """Inverse of each group's covariance, computed where the group row lives; NULL if singular."""

    @F.arrow_udf("array<double>")
    def invert(cov: pa.Array) -> pa.Array:
        out = []
        for m in list_matrix(cov).reshape(-1, p, p):
            try:
                out.append(inverse_covariance(m).ravel().tolist())
            except np.linalg.LinAlgError:
                out.append(None)
        return pa.array(out, type=pa.list_(pa.float64()))

    return groups.withColumn("inverse", invert("cov"))


def whitening_matrix(cov: np.ndarray) -> np.ndarray:
    """V · diag(1/√λ) · Vᵀ: the symmetric transform that makes the covariance the identity."""
    lam, v = np.linalg.eigh(cov)
    return v @ np.diag(1.0 / np.sqrt(lam)) @ v.T


def transform_features(df: DataFrame, vec: str, matrix: np.ndarray, mean: np.ndarray | None = None,
                       out: str = "vec") -> DataFrame:
    """Apply a linear transform, centred when a mean is given. Map-only."""
    return df.withColumn(out, linear_map(F.col(vec), matrix, mean))
