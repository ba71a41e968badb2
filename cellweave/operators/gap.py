"""Gap statistic and the choice of the number of clusters."""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.partials import PARTS, block_sums, packed_blocks
from cellweave.functions.scalars import MODULUS, uniform01
from cellweave.model import check_model_size
from cellweave.operators.kmeans import LloydFit, farthest_first, farthest_points, run_rounds


def within_cluster_distance(assigned: DataFrame) -> float:
    """Σ over clusters of Σ‖x−c‖² / n_c, from the ``dist`` and ``cluster`` columns."""
    per = assigned.groupBy("cluster").agg(
        F.sum(F.pow(F.array_min("dist"), F.lit(2.0))).alias("ss"), F.count("*").alias("n"))
    return float(per.agg(F.sum(F.col("ss") / F.col("n"))).first()[0])


def reference_points(points: DataFrame, vec: str, p: int, b: int, seed_key: str, id_col: str = "object_id") -> DataFrame:
    """As many seeded uniform points in the box of the data as there are points."""
    v = F.col(vec)
    row = points.agg(*[f(v[i]) for i in range(p) for f in (F.min, F.max)]).first()
    coords = []
    for i in range(p):
        low, high = float(row[2 * i]), float(row[2 * i + 1])
        coords.append(F.lit(low) + uniform01(seed_key, 1000 * (b + 1) + i) * F.lit(high - low))
    return points.select(id_col, F.array(*coords).alias(vec))


def _hashed_box(keys: np.ndarray, low: np.ndarray, high: np.ndarray, b: int) -> np.ndarray:
    """Rows of box b, made from the keys: the same numbers as ``reference_points``."""
    out = np.empty((len(keys), len(low)))
    for i in range(len(low)):
        seed = 1000 * (b + 1) + i
        v = (keys % MODULUS + seed * 1013904223 % MODULUS) % MODULUS
        u = (v * v % MODULUS * 48271 + v) % MODULUS
        out[:, i] = low[i] + u / MODULUS * (high[i] - low[i])
    return out


class _BoxFit(LloydFit):
    """A k-means fit of the points (box 0) or of one of the boxes."""

    def __init__(self, start: np.ndarray, box: int, tol: float):
        super().__init__(start, tol=tol)
        self.box = box


def gap_curve(points: DataFrame, vec: str, p: int, max_k: int, seed_key: str, b: int = 5, id_col: str = "object_id",
              max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """(k, gap, sk) for k = 1 … max_k: mean log W* − log W and its corrected deviation.

    Every (k, box) is a k-means fit; all of them share their rounds, each one pass over the packed points, in which tasks
    make the boxes from the keys. Farthest-first seeds of k are the first k of max_k, so each box is seeded once.
    """
    v = F.col(vec)
    row = points.agg(*[f(v[i]) for i in range(p) for f in (F.min, F.max)]).first()
    low, high = np.array(row[0::2], dtype=float), np.array(row[1::2], dtype=float)
    sets = [points.select(id_col, vec)] + [reference_points(points, vec, p, i, seed_key, id_col) for i in range(b)]
    fits: list[_BoxFit] = []
    for box, rows in enumerate(sets):
        seeds = farthest_first(rows, vec, max_k, id_col=id_col)[0]
        for k in range(1, max_k + 1):
            fits.append(_BoxFit(seeds[:k], box, tol))
    # A key below the modulus is exact as a double and hashes alike.
    keyed = points.select(F.concat(F.array((F.col(seed_key) % MODULUS).cast("double")), v).alias("x"))
    blocks = packed_blocks(keyed, "x").persist(StorageLevel.MEMORY_AND_DISK)

    def sums_of(x: np.ndarray, live: list[_BoxFit]) -> np.ndarray:
        keys, made, out = x[:, 0].astype(np.int64), {0: np.ascontiguousarray(x[:, 1:])}, []
        for f in live:
            if f.box not in made:
                made = {0: made[0], f.box: _hashed_box(keys, low, high, f.box - 1)}  # one box at a time
            out.append(f.sums(made[f.box]))
        return np.vstack(out)

    run_rounds(blocks, p + 1, fits, max_iter, sums_of, lambda f: lambda c, count: farthest_points(sets[f.box], vec, c, count, 2, None, id_col))
    final = [f.result.centroids for f in fits]
    for f, c in zip(fits, final):
        f.c = c
    check_model_size(sum(c.size for c in final), "centroids")
    sums = block_sums(blocks, p + 1, lambda x: sums_of(x, fits), sum(len(c) for c in final), p + 3, blocks.rdd.getNumPartitions() > PARTS)
    blocks.unpersist()
    logs = np.empty((len(sets), max_k))
    for at, own in enumerate(np.split(sums, np.cumsum([len(c) for c in final])[:-1])):
        some = own[:, p] > 0
        logs[divmod(at, max_k)] = math.log((own[some, p + 1] / own[some, p]).sum()) if some.any() and own[some, p + 1].sum() > 0 else -math.inf
    ref = logs[1:]
    rows = [(k + 1, float(ref[:, k].mean() - logs[0, k]), float(ref[:, k].std() * math.sqrt(1 + 1 / b))) for k in range(max_k)]
    return points.sparkSession.createDataFrame(rows, "k int, gap double, sk double")


def choose_k(curve: DataFrame) -> DataFrame:
    """Adds ``best_k``: the smallest k with gap(k) ≥ gap(k+1) − sk(k+1), −1 if there is none."""
    w = Window.orderBy("k")
    ok = F.col("gap") >= F.lead("gap").over(w) - F.lead("sk").over(w)
    marked = curve.withColumn("_ok", ok)
    best = marked.filter("_ok").agg(F.min("k")).first()[0]
    return curve.withColumn("best_k", F.lit(-1 if best is None else best))
