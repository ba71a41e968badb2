"""Exact point-to-cluster distances through block pairs: silhouette, medoids, all-point distances."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cellweave.functions.partials import list_matrix, matrix_list
from cellweave.functions.vectors import distance_matrix
from cellweave.model import MAX_MODEL_VALUES, check_model_size
from cellweave.operators.assign import assign_nearest
from cellweave.operators.blocks import BLOCK_ROWS
from cellweave.operators.kmeans import farthest_first
from cellweave.operators.regions import SAMPLE, grow_tree, region
from cellweave.session import cut_lineage, forget

#: Groups of points that meet each other, and points of a group at most; rows of sums that two groups give at most.
GROUPS, GROUP_ROWS, SUMS = 12, 65_536, 1 << 21
#: Rows of a tile of distances, dimensions in which differences are cheaper than a matrix product, and the share of the
#: norms up to which squares of distances come from true differences, so many at a time.
TILE, FLAT, CLOSE, EXACT = 256, 6, 1e-5, 1 << 16
#: Regions of all clusters together that bound the sums of medoids, and members left that are summed in one pass.
CELLS, FEW = 2048, 1024
#: Second moments of all clusters together that each task adds up.
SPREADS = 1 << 20
#: Bins of all features and clusters together, fewest and most of a feature, that bound sums of Manhattan distances.
BINS, FEW_BINS, MOST_BINS = 1 << 17, 8, 1024
#: Sums that differ by less than this share are equal: they are added in any order.
TIE = 1e-12


def _meetings(points: DataFrame, id_col: str, vec: str, label: Column, run: Callable[[_Side, _Side, bool], Iterator[pa.Table]], schema: str,
              block_rows: int, rows: int, most: int = GROUP_ROWS) -> DataFrame:
    """``run(one, other, itself)`` on every two groups of points, and on every group and itself.

    Distances are symmetric, so two groups meet once and ``run`` gives the rows of both. A point is copied once per group
    whatever their number of points, which is at most ``most``. Equal ids are in one group.
    """
    n = max(1, min(math.ceil(rows / block_rows), max(GROUPS, math.ceil(rows / most))))
    group = F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    own = points.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vec).alias("vec"), group.alias("g"))
    copies = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_m")).select(
        F.least("g", "_m").alias("l"), F.greatest("g", "_m").alias("r"), "id", "label", "vec", "g")
    empty = T._parse_datatype_string(schema)

    def meet(t: pa.Table) -> pa.Table:
        l, r = t["l"][0].as_py(), t["r"][0].as_py()
        one = _Side(t.filter(pc.equal(t["g"], l)))
        found = run(one, one if l == r else _Side(t.filter(pc.equal(t["g"], r))), l == r)
        return pa.concat_tables([to_arrow_schema(empty).empty_table(), *found])

    return copies.repartition(n * (n + 1) // 2, "l", "r").groupBy("l", "r").applyInArrow(meet, schema)


class _Side:
    """Points of a group, those of a label next to each other, and the slices of the labels."""

    def __init__(self, t: pa.Table):
        t = t.sort_by("label").combine_chunks()
        self.ids = t["id"].combine_chunks() if t.num_rows else pa.array([], t.schema.field("id").type)
        vecs = t["vec"].combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float64()))
        widths = np.unique(pc.list_value_length(vecs).to_numpy(zero_copy_only=False))
        if vecs.null_count or len(widths) > 1:
            raise ValueError("no vector, or vectors of different lengths")
        self.x = np.asarray(vecs.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(vecs), int(widths[0]) if len(widths) else 0)
        labels = pc.dictionary_encode(t["label"].combine_chunks(), null_encoding="encode") if t.num_rows else None
        codes = labels.indices.to_numpy() if t.num_rows else np.empty(0, np.int32)
        cuts = np.flatnonzero(np.diff(codes)) + 1
        self.runs = [(labels.dictionary[int(codes[i])].as_py(), slice(int(i), int(j))) for i, j in zip([0, *cuts], [*cuts, len(codes)])] if len(codes) else []

    def id_codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the ids, to compare the first with the second; a row without an id has it in common with none."""
        codes = pc.dictionary_encode(self.ids).indices
        return codes.fill_null(-1).to_numpy(zero_copy_only=False), codes.fill_null(-2).to_numpy(zero_copy_only=False)


def _tiles(rows: slice, step: int) -> list[slice]:
    return [slice(i, min(i + step, rows.stop)) for i in range(rows.start, rows.stop, step)]


class _Gaps:
    """Distances of the points of two groups by tiles: in few dimensions and where points are close from true differences."""

    def __init__(self, a: np.ndarray, b: np.ndarray, p: float):
        if len(a) and len(b) and a.shape[1] != b.shape[1]:
            raise ValueError("vectors of different lengths")
        self.a, self.b, self.p = a, b, p
        self.held = np.empty((2, 2 * TILE * TILE))  # tiles take turns in the same memory
        self.flat = p == 2 and a.shape[1] <= FLAT
        self.product = False
        if self.flat:
            self.y, self.z = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        elif p == 2 and len(a) and len(b):
            shift = a.mean(axis=0)
            self.y, self.z = a - shift, b - shift
            self.ny, self.nz = np.einsum("ij,ij->i", self.y, self.y), np.einsum("ij,ij->i", self.z, self.z)
            self.near = CLOSE * (self.ny.max() + self.nz.max())
            self.product = bool(np.isfinite(self.near))
            self.y *= -2.0

    def __call__(self, i: slice, j: slice) -> np.ndarray:
        """The distances of a tile of at most TILE and 2 TILE points, which the next call writes over."""
        shape = i.stop - i.start, j.stop - j.start
        out, part = self.held[:, :shape[0] * shape[1]].reshape(2, *shape)
        if self.flat:
            out[:] = 0.0
            for y, z in zip(self.y, self.z):
                np.subtract(y[i][:, None], z[j][None, :], out=part)
                np.multiply(part, part, out=part)
                np.add(out, part, out=out)
            return np.sqrt(out, out=out)
        if not self.product:
            return _distances(self.a[i], self.b[j], self.p)
        np.matmul(self.y[i], self.z[j].T, out=out)
        out += self.ny[i][:, None]
        out += self.nz[j][None, :]
        # a product knows the square of a distance up to a share of the norms: what is not far above that is done again
        if out.min() <= self.near:
            r, c = np.nonzero(out <= self.near)
            for at in range(0, len(r), EXACT):
                diff = self.a[r[at:at + EXACT] + i.start] - self.b[c[at:at + EXACT] + j.start]
                out[r[at:at + EXACT], c[at:at + EXACT]] = np.einsum("ij,ij->i", diff, diff)
        return np.sqrt(out, out=out)


def point_cluster_sums(assigned: DataFrame, vec: str, p: float = 2, id_col: str = "object_id",
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, own, cluster, total, n): summed distance of every point to the members of every cluster."""
    id_type = dict(assigned.dtypes)[id_col]
    schema = f"id {id_type}, own int, cluster int, total double, n bigint"

    def table(side: _Side, rows: slice, own: int, cluster: int, total: np.ndarray, n: int) -> pa.Table:
        k = rows.stop - rows.start
        return pa.table([side.ids.slice(rows.start, k), pa.array([own] * k, pa.int32()), pa.array([cluster] * k, pa.int32()),
                         pa.array(total), pa.array(np.full(k, n, np.int64))], names=["id", "own", "cluster", "total", "n"])

    def run(one: _Side, other: _Side, itself: bool) -> Iterator[pa.Table]:
        gaps = _Gaps(one.x, other.x, p)
        for a, i in one.runs:
            for b, j in other.runs:
                left, right = np.zeros(i.stop - i.start), np.zeros(j.stop - j.start)
                for u in _tiles(i, TILE):
                    for v in _tiles(j, 2 * TILE):
                        d = gaps(u, v)
                        left[u.start - i.start:u.stop - i.start] += d.sum(axis=1)
                        if not itself:
                            right[v.start - j.start:v.stop - j.start] += d.sum(axis=0)
                yield table(one, i, a, b, left, len(right))
                if not itself:
                    yield table(other, j, b, a, right, len(left))

    rows, clusters = assigned.agg(F.count("*"), F.count_distinct("cluster")).first()
    parts = _meetings(assigned, id_col, vec, F.col("cluster").cast("int"), run, schema, block_rows, rows,
                      max(1, min(GROUP_ROWS, SUMS // max(1, clusters))))
    return parts.groupBy("id", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _exact_euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differences row by row of the left block: no cancellation, memory of a part of one block row."""
    out = np.empty((len(a), len(b)))
    for at in range(0, len(b), BLOCK_ROWS):
        part = b[at:at + BLOCK_ROWS]
        for i, x in enumerate(a):
            diff = part - x
            out[i, at:at + BLOCK_ROWS] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def silhouette(assigned: DataFrame, vec: str, p: float = 2, id_col: str = "object_id",
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a = mean distance to the own cluster (the point itself included), b = smallest mean to another one."""
    mean = F.col("total") / F.col("n")
    sums = point_cluster_sums(assigned, vec, p, id_col, block_rows)
    per_point = sums.groupBy("id", "own").agg(
        F.max(F.when(F.col("cluster") == F.col("own"), mean)).alias("a"),
        F.min(F.when(F.col("cluster") != F.col("own"), mean)).alias("b"))
    top = F.greatest("a", "b")
    value = F.when(top > 0, (F.col("b") - F.col("a")) / F.when(top > 0, top)).otherwise(F.lit(0.0))
    return per_point.select(F.col("id").alias(id_col), F.col("own").alias("cluster"), "a", "b",
                            value.alias("silhouette"))


def point_distance_summary(points: DataFrame, vec: str, p: float = 2, id_col: str = "object_id",
                           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per point: mean, smallest and largest distance to all other points. The N×N matrix is never stored."""
    schema = f"id {dict(points.dtypes)[id_col]}, total double, n bigint, low double, high double"

    def run(one: _Side, other: _Side, itself: bool) -> Iterator[pa.Table]:
        gaps = _Gaps(one.x, other.x, p)
        sides = [(one, np.zeros(len(one.x)), np.zeros(len(one.x), np.int64), np.full(len(one.x), np.inf), np.full(len(one.x), -np.inf))]
        if itself:
            codes, others = one.id_codes()
        else:
            sides.append((other, np.zeros(len(other.x)), np.zeros(len(other.x), np.int64), np.full(len(other.x), np.inf), np.full(len(other.x), -np.inf)))
        for i in _tiles(slice(0, len(one.x)), TILE):
            for j in _tiles(slice(0, len(other.x)), 2 * TILE):
                d = gaps(i, j)
                same = codes[i][:, None] == others[j][None, :] if itself else None
                for (_, total, n, low, high), at, axis in zip(sides, (i, j), (1, 0)):
                    total[at] += d.sum(axis=axis) if same is None else np.where(same, 0.0, d).sum(axis=axis)
                    n[at] += d.shape[axis] if same is None else (~same).sum(axis=axis)
                    low[at] = np.minimum(low[at], (d if same is None else np.where(same, np.inf, d)).min(axis=axis))
                    high[at] = np.maximum(high[at], (d if same is None else np.where(same, -np.inf, d)).max(axis=axis))
        for side, *columns in sides:
            yield pa.table([side.ids, *map(pa.array, columns)], names=["id", "total", "n", "low", "high"])

    parts = _meetings(points, id_col, vec, F.lit(0), run, schema, block_rows, points.count())
    return parts.groupBy("id").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("low").alias("nearest"),
        F.max("high").alias("farthest")).select(
        F.col("id").alias(id_col), (F.col("total") / F.col("n")).alias("mean_distance"), "nearest", "farthest")


def _within_label_pairs(some: DataFrame, every: DataFrame, counts: dict[int, int], sizes: dict[int, int], vec: str, id_col: str,
                        block_rows: int) -> DataFrame:
    """Blocks of some rows of each cluster next to all blocks of the cluster; a big cluster splits into many blocks."""

    def packed(df: DataFrame, rows: dict[int, int]) -> tuple[DataFrame, dict, dict]:
        width = {c: max(1, math.ceil(n / block_rows)) for c, n in sorted(rows.items())}
        first = dict(zip(width, np.cumsum([0, *width.values()])[:-1].tolist()))
        of = lambda m: F.create_map(*[F.lit(x) for c in m for x in (c, m[c])])[F.col("cluster")]
        blocks = df.select((of(first) + F.pmod(F.xxhash64(id_col), of(width))).cast("int").alias("block"), "cluster",
                           F.struct(F.col(id_col).alias("id"), F.col(vec).alias("vec")).alias("r"))
        return blocks.groupBy("block", "cluster").agg(F.collect_list("r").alias("rs")), first, width

    left, _, _ = packed(some, counts)
    right, first, width = packed(every, sizes)
    lo = F.create_map(*[F.lit(x) for c in first for x in (c, first[c])])[F.col("cluster")]
    hi = F.create_map(*[F.lit(x) for c in first for x in (c, first[c] + width[c] - 1)])[F.col("cluster")]
    left = left.select("cluster", F.col("block").alias("lb"), F.col("rs.id").alias("lids"), F.col("rs.vec").alias("lvecs"),
                       F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("rb"))
    return left.join(right.select(F.col("block").alias("rb"), F.col("rs.vec").alias("rvecs")), "rb").repartition("lb", "rb")


def _distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    return _exact_euclid(a, b) if p == 2 else distance_matrix(a, b, p)


def _per_cluster(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cluster, rows, vectors) of a batch of (…, cluster, vec)."""
    labels, x = batch.column("cluster").to_numpy(), np.asarray(list_matrix(batch.column("vec")), dtype=float)
    for c in np.unique(labels):
        rows = np.flatnonzero(labels == c)
        yield int(c), rows, x[rows]


def _sums_to(table: DataFrame, chosen: dict[int, np.ndarray], p: float) -> dict[int, np.ndarray]:
    """Summed distances of a few chosen vectors of each cluster to all its points: one pass, one row per task and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = {c: np.zeros(len(v)) for c, v in chosen.items()}
        for batch in batches:
            for c, _, x in _per_cluster(batch):
                if c in acc:
                    acc[c] += _distances(chosen[c], x, p).sum(axis=1)
        for c, s in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), c, dtype=np.int32)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)],
                                             names=["cluster", "at", "total"])

    out = {c: np.zeros(len(v)) for c, v in chosen.items()}
    parts = table.select("cluster", "vec").mapInArrow(run, "cluster int, at int, total double")
    for r in parts.groupBy("cluster", "at").agg(F.sum("total").alias("total")).collect():
        out[r["cluster"]][r["at"]] = r["total"]
    return out


def _cells(table: DataFrame, width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(means, counts) of the regions of each cluster."""
    sums = table.groupBy("cluster", "region").agg(F.count("*").alias("n"), F.array(*[F.avg(F.col("vec")[i]) for i in range(width)]).alias("mean"))
    found: dict[int, list] = {}
    for r in sums.collect():
        found.setdefault(r["cluster"], []).append((r["mean"], r["n"]))
    return {c: (np.array([m for m, _ in v]), np.array([n for _, n in v], dtype=float)) for c, v in found.items()}


def _spreads(table: DataFrame, width: int) -> dict[int, tuple[np.ndarray, float, np.ndarray, float]]:
    """(mean, mean of |z|², second moments of (|z|² less its mean, z), size) of each cluster, z being member less mean."""
    means = {r["cluster"]: np.array(r["m"]) for r in table.groupBy("cluster").agg(
        F.array(*[F.avg(F.col("vec")[i]) for i in range(width)]).alias("m")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = {c: np.zeros((width + 2, width + 2)) for c in means}
        for batch in batches:
            for c, _, x in _per_cluster(batch):
                z = x - means[c]
                h = np.column_stack([np.ones(len(z)), np.einsum("ij,ij->i", z, z), z])
                acc[c] += h.T @ h
        for c, s in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, c, dtype=np.int32)), pa.array(np.arange(s.size, dtype=np.int32)),
                                              pa.array(s.ravel())], names=["cluster", "at", "total"])

    sums = {c: np.zeros((width + 2) ** 2) for c in means}
    parts = table.select("cluster", "vec").mapInArrow(run, "cluster int, at int, total double")
    for r in parts.groupBy("cluster", "at").agg(F.sum("total").alias("total")).collect():
        sums[r["cluster"]][r["at"]] = r["total"]
    out = {}
    for c, s in sums.items():
        s = s.reshape(width + 2, width + 2)
        n, first = s[0, 0], s[0, 1:]
        # the rest of rounding in the mean of z is taken out as well
        out[c] = means[c] + first[1:] / n, first[0] / n - float(first[1:] @ first[1:]) / n ** 2, s[1:, 1:] - np.outer(first, first) / n, n
    return out


def _spread_bounds(x: np.ndarray, mean: np.ndarray, w: float, second: np.ndarray, n: float) -> np.ndarray:
    """Least possible summed Euclidean distances of ``x`` to a cluster of these moments.

    √u ≥ (3u − u²) / 2 for every u ≥ 0, since s³ − 3s + 2 = (s − 1)²(s + 2). With t the mean squared distance of a point
    and V the sum of the squared deviations from it, the sum is at least √t (n − V / 2t²).
    """
    y = x - mean
    e = np.column_stack([np.ones(len(y)), -2 * y])
    t = np.einsum("ij,ij->i", y, y) + w
    v = np.maximum(np.einsum("ij,ij->i", e @ second, e), 0.0)
    safe = np.where(t > 0, t, 1.0)
    return np.where(t > 0, np.sqrt(safe) * (n - v / (2 * safe * safe)), 0.0)


@dataclass(frozen=True)
class _Bins:
    """Sorted cuts of each feature of a cluster, and members and sums of values (less the middle cut) of each bin."""

    cuts: np.ndarray
    n: np.ndarray
    sums: np.ndarray

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Least possible summed Manhattan distances of ``x`` to the cluster.

        The sum splits into features. Members in lower and in higher bins count exactly by their number and sum, those of
        the bin of a value v by |number · v − sum|, so only what lies about v within its own bin is missing.
        """
        out = np.zeros(len(x))
        for f, cuts in enumerate(self.cuts):
            n, s, v = self.n[f], self.sums[f], x[:, f] - cuts[len(cuts) // 2]
            at = np.searchsorted(cuts, x[:, f], side="right")
            below_n, below_s = np.cumsum(n) - n, np.cumsum(s) - s
            above_n, above_s = n.sum() - below_n - n, s[::-1].cumsum()[::-1] - s
            out += v * (below_n - above_n)[at] + (above_s - below_s)[at] + np.abs(n[at] * v - s[at])
        return out


def _bins(table: DataFrame, sizes: dict[int, int], width: int) -> dict[int, _Bins]:
    """Bins of the features of each cluster: cuts from a bounded sample, which decides how close the bounds are and no more."""
    many = min(MOST_BINS, BINS // (len(sizes) * width)) - 1
    most = min(SAMPLE, MAX_MODEL_VALUES // (4 * width))
    shares = {c: int(min(1.0, most / (len(sizes) * n)) * (1 << 31)) for c, n in sizes.items()}
    share = F.create_map(*[F.lit(x) for c in shares for x in (c, shares[c])])[F.col("cluster")]
    found = table.filter(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 31)) < share).select("cluster", "vec").limit(2 * most).toArrow()
    cuts = {c: np.zeros((width, many)) for c in sizes}
    for batch in found.combine_chunks().to_batches():
        for c, _, x in _per_cluster(batch):
            cuts[c] = np.ascontiguousarray(np.quantile(x, np.linspace(0, 1, many), axis=0, method="nearest").T)
    check_model_size(3 * sum(c.size for c in cuts.values()), "bins of features")
    order = {c: i for i, c in enumerate(cuts)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, _, x in _per_cluster(batch):
                at = np.stack([np.searchsorted(k, x[:, f], side="right") + f * (many + 1) for f, k in enumerate(cuts[c])], axis=1).ravel()
                own = acc.setdefault(c, np.zeros((2, width * (many + 1))))
                own[0] += np.bincount(at, minlength=own.shape[1])
                own[1] += np.bincount(at, weights=(x - cuts[c][:, many // 2]).ravel(), minlength=own.shape[1])
        for c, own in acc.items():
            n, s = own.reshape(2, width, many + 1)
            yield pa.RecordBatch.from_arrays([pa.array(order[c] * width + np.arange(width, dtype=np.int32), pa.int32()), matrix_list(np.hstack([n, s]))],
                                             names=["row", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, part in zip(batch.column("row").to_pylist(), list_matrix(batch.column("part"))):
                acc[row] = acc[row] + part if row in acc else part.copy()
        for row, part in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), matrix_list(part[None])], names=["row", "part"])

    # the tasks add up, each its own features, and the driver gets each sum once
    schema = "row int, part array<double>"
    parts = table.select("cluster", "vec").mapInArrow(run, schema).repartition("row").mapInArrow(add, schema).toArrow().combine_chunks()
    sums = np.zeros((len(cuts) * width, 2 * (many + 1)))
    sums[parts.column("row").to_numpy()] = list_matrix(parts.column("part").combine_chunks())
    sums = sums.reshape(len(cuts), width, 2, many + 1)
    return {c: _Bins(cuts[c], sums[i, :, 0], sums[i, :, 1]) for c, i in order.items()}


def medoids(assigned: DataFrame, vec: str, p: float = 2, id_col: str = "object_id",
            block_rows: int = BLOCK_ROWS, work: dict | None = None) -> DataFrame:
    """(cluster, id, vec, cost): the member with the smallest summed distance to its cluster, ties to the lowest id.

    A norm is convex, so the distances of a point to the members of a region sum to at least their number times the
    distance to their mean. These bounds need one distance per region; for Euclidean distances the second moments of the
    cluster give another one, which is close where distances are nearly equal, as in many dimensions. Sums of Manhattan
    distances split into features, whose bins bound them closely without any distance. The exact sum of the member with the
    least bound then eliminates every member whose bound is larger, and only the rest is summed exactly. ``work`` receives
    the number of distances computed and of those between all members.
    """
    spark = assigned.sparkSession
    table = assigned.select(F.col(id_col).alias("id"), F.col("cluster").cast("int").alias("cluster"), F.col(vec).cast("array<double>").alias("vec"))
    id_type = dict(assigned.dtypes)[id_col]
    out_type = f"cluster int, {id_col} {id_type}, cost double, {vec} array<double>"
    table = cut_lineage(table)
    sizes = {r["cluster"]: r["count"] for r in table.groupBy("cluster").count().collect()}
    if not sizes:
        forget(table)
        return spark.createDataFrame([], out_type)
    rows, width = sum(sizes.values()), table.select(F.size("vec")).first()[0]
    check_model_size(len(sizes) * width, "medoids")
    bins, cells = {}, {}
    if p == 1 and width and BINS // (len(sizes) * width) >= FEW_BINS:
        bins = _bins(table, sizes, width)
    else:
        tree = grow_tree(table, "vec", min(max(1, CELLS // len(sizes)), max(1, rows // 16)), rows, "id")
        cells = _cells(table.withColumn("region", region("vec", tree)), width)
        check_model_size(sum(m.size for m, _ in cells.values()), "region means")
    spreads = _spreads(table, width) if p == 2 and len(sizes) * (width + 2) ** 2 <= SPREADS else {}

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = np.zeros(batch.num_rows)
            for c, at, x in _per_cluster(batch):
                if c in bins:
                    low[at] = bins[c].bounds(x)
                    continue
                means, n = cells[c]
                low[at] = _distances(x, means, p) @ n
                if c in spreads:
                    low[at] = np.maximum(low[at], _spread_bounds(x, *spreads[c]))
            yield batch.append_column("low", pa.array(low * (1 - 1e-9)))

    bounded = cut_lineage(table.mapInArrow(bounds, f"id {id_type}, cluster int, vec array<double>, low double"), table)
    first = {r["cluster"]: np.array([r["m"]["vec"]]) for r in
             bounded.groupBy("cluster").agg(F.min(F.struct("low", "id", "vec")).alias("m")).collect()}
    best = {c: float(s[0]) * (1 + 1e-9) for c, s in _sums_to(bounded, first, p).items()}
    limit = F.create_map(*[F.lit(x) for c in best for x in (c, best[c])])[F.col("cluster")]
    left = bounded.filter(F.col("low") <= limit).select("id", "cluster", "vec")
    counts = {r["cluster"]: r["count"] for r in left.groupBy("cluster").count().collect()}
    if work is not None:
        work.update(all=sum(n * n for n in sizes.values()), distances=rows + sum(
            sizes[c] * len(m) for c, (m, _) in cells.items()) + sum(n * sizes[c] for c, n in counts.items()))
    if sum(counts.values()) <= min(FEW, MAX_MODEL_VALUES // max(1, width)):
        chosen: dict[int, list] = {}
        for r in left.collect():
            chosen.setdefault(r["cluster"], []).append((r["id"], r["vec"]))
        totals = _sums_to(bounded, {c: np.array([v for _, v in m]) for c, m in chosen.items()}, p)
        near = {c: t.min() * (1 + TIE) for c, t in totals.items()}
        found = [(c, *min((i, float(t), v) for t, (i, v) in zip(totals[c], m) if t <= near[c])) for c, m in chosen.items()]
    else:
        def run(batches):
            for batch in batches:
                for r in batch.itertuples(index=False):
                    yield pd.DataFrame({"id": np.asarray(r.lids), "cluster": r.cluster, "total": _distances(np.stack(r.lvecs), np.stack(r.rvecs), p).sum(axis=1)})

        parts = _within_label_pairs(left, bounded, counts, sizes, "vec", "id", block_rows).select("cluster", "lids", "lvecs", "rvecs").mapInPandas(
            run, f"id {id_type}, cluster int, total double")
        cost = parts.groupBy("id", "cluster").agg(F.sum("total").alias("cost"))
        cost = cut_lineage(cost)
        near = cost.groupBy("cluster").agg((F.min("cost") * (1 + TIE)).alias("near"))
        lowest = cost.join(near, "cluster").filter("cost <= near").groupBy("cluster").agg(F.min(F.struct("id", "cost")).alias("m")).select("cluster", "m.*")
        found = [(r["cluster"], r["id"], r["cost"], r["vec"]) for r in left.join(lowest, ["cluster", "id"]).collect()]
        forget(cost)
    forget(bounded)
    return spark.createDataFrame(found, out_type)


def kmedoids(points: DataFrame, vec: str, k: int, p: float = 2, max_iter: int = 50, id_col: str = "object_id",
             start: np.ndarray | None = None, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, list, list[float]]:
    """Alternate nearest-medoid assignment and in-cluster medoids until the medoids stay.

    Returns medoid vectors, their ids and the total distance after each round.
    """
    if start is None:
        c, ids = farthest_first(points, vec, k, p, id_col)
    else:
        c, ids = np.asarray(start, dtype=float), [None] * k
    costs: list[float] = []
    for _ in range(max_iter):
        rows = medoids(assign_nearest(points, vec, c, p), vec, p, id_col, block_rows).collect()
        new, new_ids = c.copy(), list(ids)
        for r in rows:
            new[r["cluster"]] = r[vec]
            new_ids[r["cluster"]] = r[id_col]
        costs.append(float(sum(r["cost"] for r in rows)))
        stable = new_ids == ids
        c, ids = new, new_ids
        if stable:
            break
    return c, ids, costs


