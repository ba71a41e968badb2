"""Compact regions of points, so that far rows need not be compared one by one.

A tree of half-spaces is grown on a bounded sample, and every point walks down it in a batch kernel, without a shuffle.
The sample only decides how compact the regions are: what is built on them stays exact whatever it holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.partials import list_matrix, matrix_list
from cellweave.model import MAX_MODEL_VALUES
from cellweave.operators.blocks import BLOCK_ROWS, blocked_reduce

#: Rows the tree is grown on, and its greatest depth.
SAMPLE, MAX_DEPTH = 32_768, 12
#: Block extents compared at a time.
EXTENTS = 512


@dataclass(frozen=True)
class RegionTree:
    """Full binary tree: node i sends x to 2i + 2 if x·directions[i] > cuts[i], else to 2i + 1."""

    directions: np.ndarray
    cuts: np.ndarray
    depth: int

    def region_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            side = np.einsum("ij,ij->i", x, self.directions[node]) > self.cuts[node]
            node = 2 * node + 1 + side
        return node - (2 ** self.depth - 1)

    @property
    def regions(self) -> int:
        return 2 ** self.depth


def _main_direction(x: np.ndarray) -> np.ndarray:
    """A few power steps towards the direction of largest variance, from the direction to the farthest point."""
    y = x - x.mean(axis=0)
    w = y[np.einsum("ij,ij->i", y, y).argmax()]
    for _ in range(4):
        norm = np.linalg.norm(w)
        if not norm:
            break
        w = y.T @ (y @ (w / norm))
    norm = np.linalg.norm(w)
    return w / norm if norm else w


def grow_tree(points: DataFrame, vec: str, regions: int, rows: int, id_col: str = "object_id") -> RegionTree:
    """Tree of about ``regions`` regions (a power of two, at most 2^MAX_DEPTH) of a table of ``rows`` points."""
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, regions)))))
    share = F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(1 << 31)) < int(min(1.0, SAMPLE / max(1, rows)) * (1 << 31))
    width = points.select(F.size(vec)).first()
    limit = min(2 * SAMPLE, MAX_MODEL_VALUES // max(1, width[0])) if width else 0
    found = points.filter(share).select(vec).limit(limit).toArrow() if depth and width else None
    p = width[0] if width else 0
    directions, cuts = np.zeros((2 ** depth - 1, p)), np.zeros(2 ** depth - 1)
    if found is None or not found.num_rows:
        return RegionTree(directions, cuts, depth if width else 0)
    x = np.asarray(list_matrix(found.column(0).combine_chunks()), dtype=float)
    members = [np.arange(len(x))]
    for node in range(2 ** depth - 1):
        own = x[members[node]]
        right = np.zeros(len(own), dtype=bool)
        if len(own) > 1:
            directions[node] = _main_direction(own)
            along = np.einsum("ij,j->i", own, directions[node])
            cuts[node] = np.median(along)
            right = along > cuts[node]
        members += [members[node][~right], members[node][right]]
    return RegionTree(directions, cuts, depth)


def region(vec: str, tree: RegionTree) -> Column:
    """Region number of a point."""

    @F.arrow_udf("int")
    def walk(v: pa.Array) -> pa.Array:
        return pa.array(tree.region_of(np.asarray(list_matrix(v), dtype=float)).astype(np.int32))

    return walk(F.col(vec))


def compact_blocks(points: DataFrame, vec: str, id_col: str, rows: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """``points`` with a block number, and the number of blocks of about ``block_rows`` rows; a full region is split by hash."""
    if rows <= block_rows:
        return points.withColumn("block", F.lit(0)), 1
    tree = grow_tree(points, vec, math.ceil(rows / block_rows), rows, id_col)
    placed = points.withColumn("_region", region(vec, tree))
    sizes = np.zeros(tree.regions, dtype=np.int64)
    for r in placed.groupBy("_region").count().collect():
        sizes[r["_region"]] = r["count"]
    width = np.maximum(1, -(-sizes // block_rows))
    first = np.cumsum(width) - width

    @F.arrow_udf("int")
    def block(at: pa.Array, h: pa.Array) -> pa.Array:
        r = at.to_numpy(zero_copy_only=False)
        return pa.array((first[r] + h.to_numpy(zero_copy_only=False) % width[r]).astype(np.int32))

    return placed.withColumn("block", block("_region", F.pmod(F.xxhash64(id_col), F.lit(1 << 31)))).drop("_region"), int(width.sum())


def extent(x: np.ndarray) -> np.ndarray:
    """Lowest and highest corner, centre and radius of some points."""
    c = x.mean(axis=0)
    return np.concatenate([x.min(0), x.max(0), c, [np.sqrt(((x - c) ** 2).sum(axis=1).max())]])


def extents(placed: DataFrame, vec: str) -> DataFrame:
    """(block, n, extent): lowest and highest corner, centre and radius of every block in one array."""

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                yield pd.DataFrame({"block": [r.block], "n": [len(r.vecs)], "extent": [extent(np.stack(r.vecs))]})

    return placed.groupBy("block").agg(F.collect_list(vec).alias("vecs")).mapInPandas(run, "block int, n bigint, extent array<double>")


def least_distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """No point of block i of ``a`` is nearer to one of block j of ``b`` than this: boxes and balls, whichever says more."""
    box = np.zeros((len(a), len(b)))
    for f in range(p):
        gap = np.maximum(a[:, None, f] - b[None, :, p + f], b[None, :, f] - a[:, None, p + f])
        box += np.square(np.maximum(gap, 0.0))
    ball = centre_distances(a, b, p) - a[:, None, 3 * p] - b[None, :, 3 * p]
    # a little less, for the rounding of either side
    return np.maximum(np.sqrt(box), ball) * (1 - 1e-9) - 1e-12 * np.abs(b[:, 2 * p:3 * p]).max(initial=0.0)


def centre_distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for f in range(2 * p, 3 * p):
        out += np.square(a[:, None, f] - b[None, :, f])
    return np.sqrt(out)


def block_pairs_by(described: DataFrame, kernel, schema: str, n_blocks: int) -> DataFrame:
    """``kernel(ids, labels, extents, ids, labels, extents)`` on chunks of (block, label, extent): only extents meet, no points."""
    return blocked_reduce(described, "block", "extent", "label", kernel, schema, EXTENTS, n_blocks)
