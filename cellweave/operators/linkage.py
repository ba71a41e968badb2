"""Hierarchical clustering in rounds of parallel merges.

Single linkage on points is a minimum spanning tree (Borůvka). Ward on points
needs only centroids and sizes. The other reducible methods work on a distance
table between groups: every round merges all reciprocal nearest neighbours.
Ties break by (distance, smaller id, larger id) everywhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.partials import list_matrix, matrix_list
from cellweave.operators import regions
from cellweave.operators.blocks import BLOCK_ROWS, blocked_reduce
from cellweave.operators.order_stats import distributed_rank, running_totals
from cellweave.operators.silhouette import _exact_euclid
from cellweave.session import cut_lineage, forget

TABLE_METHODS = ("single", "complete", "average", "weighted", "ward")


def _reciprocal(nn: DataFrame) -> DataFrame:
    """Rows (a, b, d) with a < b that are each other's nearest neighbour. ``nn``: (i, j, d)."""
    back = nn.select(F.col("i").alias("j"), F.col("j").alias("_back"))
    return nn.join(back, "j").filter((F.col("_back") == F.col("i")) & (F.col("i") < F.col("j"))).select(
        F.col("i").alias("a"), F.col("j").alias("b"), "d")


def _combined(method: str) -> Column:
    """Distance of a row cluster x to the union of the clusters y grouped with it."""
    d, ny = F.col("d"), F.col("ny").cast("double")
    if method == "single":
        return F.min(d)
    if method == "complete":
        return F.max(d)
    if method == "average":
        return F.sum(ny * d) / F.sum(ny)
    if method == "weighted":
        return F.avg(d)
    nx, h = F.first("nx").cast("double"), F.first("h")
    joint = (F.sum((ny + F.col("nx")) * d * d) - nx * h * h) / (F.sum(ny) + nx)
    return F.when(F.count("*") == 2, F.sqrt(F.greatest(joint, F.lit(0.0)))).otherwise(F.first("d"))


def _collapse(edges: DataFrame, merged: DataFrame, method: str) -> DataFrame:
    """Replace the y side by its merged cluster and swap the sides."""
    joined = edges.join(merged.withColumnRenamed("old", "y"), "y", "left").select(
        "x", "nx", F.coalesce("new", "y").alias("y"), "ny", "d", "h")
    out = joined.groupBy("x", "y").agg(F.first("nx").alias("nx"), F.sum("ny").alias("ny"), _combined(method).alias("d"))
    return out.select(F.col("y").alias("x"), F.col("ny").alias("nx"), F.col("x").alias("y"), F.col("nx").alias("ny"), "d")


def table_linkage(distances: DataFrame, method: str = "average", row: str = "row_id", col: str = "col_id",
                  value: str = "distance") -> DataFrame:
    """Merges (a, b, distance, size, round) of a symmetric distance table with long ids.

    a and b are the smallest members of the merged clusters. The table has one
    row per ordered pair, so this is for groups, centroids and similar sets.
    """
    if method not in TABLE_METHODS:
        raise ValueError(f"no such linkage method: {method}")
    edges = distances.filter(F.col(row) != F.col(col)).select(
        F.col(row).cast("bigint").alias("x"), F.lit(1).cast("bigint").alias("nx"),
        F.col(col).cast("bigint").alias("y"), F.lit(1).cast("bigint").alias("ny"), F.col(value).alias("d"))
    edges = cut_lineage(edges)
    merges: DataFrame | None = None
    turn = 0
    while True:
        turn += 1
        nn = edges.groupBy(F.col("x").alias("i")).agg(
            F.min(F.struct("d", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "y", "nx", "ny")).alias("m"))
        nn = nn.select("i", F.col("m.y").alias("j"), F.col("m.d").alias("d"), (F.col("m.nx") + F.col("m.ny")).alias("n"))
        found = cut_lineage(_reciprocal(nn).join(nn.select(F.col("i").alias("a"), "n"), "a").select(
            "a", "b", F.col("d").alias("distance"), F.col("n").cast("bigint").alias("size"), F.lit(turn).alias("round")))
        if found.isEmpty():
            return found if merges is None else merges
        pairs = found.select(F.explode(F.array("a", "b")).alias("old"), F.col("a").alias("new"), F.col("distance").alias("h"))
        edges = cut_lineage(_collapse(_collapse(edges, pairs, method), pairs, method).filter("x <> y"), edges)
        merges = found if merges is None else merges.union(found)


ORDER = ("distance", "round", "a", "b")


# ---- trees ----------------------------------------------------------------------


def ordered_merges(merges: DataFrame) -> DataFrame:
    """Merges with merge_no (from 0): by height, children first on ties; stored."""
    ranked = distributed_rank(merges, ORDER)
    return cut_lineage(ranked.withColumn("merge_no", F.col("position") - 1).drop("position"))


def numbered_tree(ordered: DataFrame, n: int) -> DataFrame:
    """(merge_no, left, right, distance, size) of ordered merges of n leaves; the cluster of merge i is n + i.

    A merge keeps a, its smallest member, and b is not met again. So the right-hand node is the last merge that kept b,
    and the left-hand node the merge before this one among those that kept a: the one before in a running count per a,
    which a cluster that takes part in most merges does not bring to one task.
    """
    last = ordered.groupBy(F.col("a").alias("b")).agg(F.max("merge_no").alias("_last"))
    steps = cut_lineage(distributed_rank(ordered, ["merge_no"], ["a"], "_step"))
    before = steps.select("a", (F.col("_step") + 1).alias("_step"), F.col("merge_no").alias("_before"))
    joined = steps.join(before, ["a", "_step"], "left").join(last, "b", "left")
    one, two = F.coalesce(F.col("_before") + n, "a"), F.coalesce(F.col("_last") + n, "b")
    return joined.select("merge_no", F.least(one, two).alias("left"), F.greatest(one, two).alias("right"),
                         F.col("distance").cast("double").alias("distance"), F.col("size").cast("bigint").alias("size"))


def numbered_components(labels: DataFrame) -> DataFrame:
    """(id, cluster) from (id, component): components numbered by their smallest id, which is their name."""
    names = distributed_rank(labels.select("component").distinct(), ["component"])
    return labels.join(names, "component").select("id", (F.col("position") - 1).cast("int").alias("cluster"))


def cut_tree(ordered: DataFrame, leaves: DataFrame, k: int) -> DataFrame:
    """(id, cluster) of the leaves after the first n − k merges; clusters numbered by their smallest leaf.

    Each merge hangs b on a once; following these links doubles the distance every round.
    """
    n = leaves.count()
    links = ordered.filter(F.col("merge_no") < n - k).select(F.col("b").alias("id"), "a")
    parents = leaves.select(F.col("id").cast("bigint").alias("id")).join(links, "id", "left").select(
        F.col("id").alias("node"), F.coalesce("a", "id").alias("parent"))
    return numbered_components(_jump(cut_lineage(parents)).select(F.col("node").alias("id"), F.col("parent").alias("component")))


# ---- merge histories --------------------------------------------------------------


def _variance(n: Column, s: Column, q: Column) -> Column:
    """Variance of a cluster with moments (n, Σx, Σx²), summed over the features."""
    per_feature = F.zip_with(s, q, lambda a, b: F.greatest(b / n - (a / n) * (a / n), F.lit(0.0)))
    return F.when(n > 0, F.aggregate(per_feature, F.lit(0.0), lambda t, x: t + x)).otherwise(F.lit(0.0))


def merge_history(merges: DataFrame, leaves: DataFrame) -> DataFrame:
    """One row per merge with members and variance of the two clusters before and of the one after it.

    ``leaves``: (id, n, s, q), the moments of each leaf. The merges of a round do not depend on each other, so moments
    go up the tree round by round, each a join of its merges with the clusters alive.
    """
    alive = cut_lineage(leaves.select(F.col("id").cast("bigint").alias("id"), F.col("n").cast("double").alias("n"), "s", "q",
                                      F.lit(1).cast("bigint").alias("members")))
    out = None
    for turn in range(1, (merges.agg(F.max("round")).first()[0] or 0) + 1):
        a = alive.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("n", "s", "q", "members")])
        b = alive.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("n", "s", "q", "members")])
        added = {c: F.zip_with(f"{c}_a", f"{c}_b", lambda x, y: x + y) for c in ("s", "q")}
        step = cut_lineage(merges.filter(F.col("round") == turn).join(a, "a").join(b, "b").select(
            *ORDER, (F.col("n_a") + F.col("n_b")).alias("n"), added["s"].alias("s"), added["q"].alias("q"),
            (F.col("members_a") + F.col("members_b")).alias("members"), "members_a", "members_b",
            _variance(F.col("n_a"), F.col("s_a"), F.col("q_a")).alias("v_a"), _variance(F.col("n_b"), F.col("s_b"), F.col("q_b")).alias("v_b")))
        gone = step.select(F.explode(F.array("a", "b")).alias("id"))
        alive = cut_lineage(alive.join(gone, "id", "left_anti").unionByName(
            step.select(F.col("a").alias("id"), "n", "s", "q", "members")), alive)
        rows = step.select(*ORDER, "members", "members_a", "members_b", _variance(F.col("n"), F.col("s"), F.col("q")).alias("v"), "v_a", "v_b")
        out = rows if out is None else out.union(rows)
    return out


def merge_scan(history: DataFrame, leaves: DataFrame) -> DataFrame:
    """(merge_no, total_variance, mean_positive, n_positive) after each merge: totals of the leaves plus running changes."""
    def positive(v: str) -> Column:
        return (F.col(v) > 1e-12).cast("bigint")

    v = _variance(F.col("n").cast("double"), F.col("s"), F.col("q"))
    start = leaves.select(v.alias("v")).agg(
        F.sum("v").alias("t"), F.sum(F.col("v") * positive("v")).alias("p"), F.sum(positive("v")).alias("k")).first()
    sums = {
        "_t": F.col("v") - F.col("v_a") - F.col("v_b"),
        "_p": F.col("v") * positive("v") - F.col("v_a") * positive("v_a") - F.col("v_b") * positive("v_b"),
        "_k": positive("v") - positive("v_a") - positive("v_b"), "_no": F.lit(1).cast("bigint")}
    run = running_totals(history, [], ORDER, sums)
    n = F.col("_k") + F.lit(start["k"])
    return run.select((F.col("_no") - 1).alias("merge_no"), (F.col("_t") + F.lit(start["t"])).alias("total_variance"),
                      F.when(n > 0, (F.col("_p") + F.lit(start["p"])) / n).otherwise(F.lit(0.0)).alias("mean_positive"),
                      n.alias("n_positive"))


def big_cluster_scan(history: DataFrame, leaves: DataFrame, minimum: int) -> DataFrame:
    """(merge_no, n_big): clusters with at least ``minimum`` leaves after each merge."""
    def big(c: str) -> Column:
        return (F.col(c) >= minimum).cast("bigint")

    start = leaves.count() if minimum <= 1 else 0
    run = running_totals(history, [], ORDER, {
        "_b": big("members") - big("members_a") - big("members_b"), "_no": F.lit(1).cast("bigint")})
    return run.select((F.col("_no") - 1).alias("merge_no"), (F.col("_b") + start).alias("n_big"))


# ---- points -------------------------------------------------------------------


#: Links or edges that the driver follows itself: a table of two numbers each, far below what a model may hold.
LOCAL = 1 << 20


def _roots(node: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Root of every node by doubling steps; every parent is a node."""
    order = np.argsort(node)
    at = order[np.searchsorted(node[order], parent)]
    while True:
        further = at[at]
        if np.array_equal(further, at):
            return node[at]
        at = further


def _jump(parents: DataFrame) -> DataFrame:
    """Follow (node, parent) links to the roots; doubles the distance per step. Few links are followed by the driver."""
    if parents.count() <= LOCAL:
        t = parents.select("node", "parent").toArrow()
        if not t["node"].null_count and not t["parent"].null_count:
            node, parent = t["node"].to_numpy(), t["parent"].to_numpy()
            if len(np.unique(node)) == len(node) and np.isin(parent, node).all():
                return parents.sparkSession.createDataFrame(pa.table({"node": node, "parent": _roots(node, parent)}))
    current = parents
    while True:
        up = current.select(F.col("node").alias("parent"), F.col("parent").alias("_grand"))
        step = current.join(up, "parent").select("node", F.col("_grand").alias("parent"), "parent")
        step = cut_lineage(step.toDF("node", "parent", "_old"))
        moved = step.filter("parent <> _old").limit(1).count()
        current = step.select("node", "parent")
        if not moved:
            return current


#: Nearest points listed for each point, groups of points that meet each other, and points of a group at most.
LISTED, GROUPS, GROUP_ROWS = 8, 12, 65_536
#: Distances computed at a time from true differences.
EXACT = 1 << 16


class _Side:
    """Points of one side of a meeting, in order of their blocks, with the extent of each block."""

    def __init__(self, t: pa.Table, width: int, origin: np.ndarray | None = None):
        t = t.sort_by("block").combine_chunks()
        self.ids, self.comps, self.reach = (t[c].to_numpy() for c in ("id", "comp", "reach"))
        self.x = np.asarray(list_matrix(t["vec"].combine_chunks()), dtype=float) if t.num_rows else np.empty((0, width))
        if self.x.shape[1] != width:
            raise ValueError("vectors of different lengths")
        self.origin = origin if origin is not None else self.x.mean(axis=0) if len(self.x) else np.zeros(width)
        self.y = self.x - self.origin
        self.norms = np.einsum("ij,ij->i", self.y, self.y)
        block = t["block"].to_numpy()
        cuts = np.flatnonzero(np.diff(block)) + 1
        self.tiles = [slice(int(i), int(j)) for i, j in zip([0, *cuts], [*cuts, len(block)])] if len(block) else []

    def extents(self) -> np.ndarray:
        return np.stack([regions.extent(self.x[t]) for t in self.tiles])


def _squares(left: _Side, i: slice, right: _Side, j: slice) -> np.ndarray:
    """Squared distances of two blocks by one matrix product, known up to ``_rounding``."""
    d = left.y[i] @ right.y[j].T
    d *= -2.0
    d += left.norms[i][:, None]
    d += right.norms[j][None, :]
    return d


def _rounding(left: _Side, right: _Side) -> float:
    return 8 * (left.x.shape[1] + 8) * np.finfo(float).eps * max(left.norms.max(initial=0.0), right.norms.max(initial=0.0))


def _true_distances(left: _Side, i: np.ndarray, right: _Side, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), EXACT):
        diff = right.x[j[at:at + EXACT]] - left.x[i[at:at + EXACT]]
        out[at:at + EXACT] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def _nearest_tiles(left: _Side, right: _Side, width: int):
    """(tile of the left side, its tiles of the right side with the least distance to them, nearest first)."""
    if left.tiles and right.tiles:
        least = regions.least_distances(left.extents(), right.extents(), width)
        for i, row in zip(left.tiles, least):
            yield i, [(right.tiles[j], row[j]) for j in np.argsort(row, kind="stable")]


def _fewest(row: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least values of each row."""
    order = np.lexsort((d, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < k]


def _listed(left: _Side, right: _Side, width: int) -> tuple[list[pa.Table], int]:
    """The LISTED nearest points of another id within reach of each left point, and what all others are not nearer than."""
    ids, others, ds, bounds, done = [], [], [], [], 0
    eps = _rounding(left, right)
    for i, tiles in _nearest_tiles(left, right, width):
        limit = np.square(left.reach[i]) + eps
        row, col, sq = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        for j, least in tiles:
            if least * least > limit.max():
                break
            done += 1
            d = _squares(left, i, right, j)
            r, c = np.nonzero(d <= limit[:, None])
            other = left.ids[i][r] != right.ids[j][c]
            r, c = r[other], c[other]
            row, col, sq = np.concatenate([row, r]), np.concatenate([col, c + j.start]), np.concatenate([sq, d[r, c]])
            keep = _fewest(row, sq, LISTED)
            row, col, sq = row[keep], col[keep], sq[keep]
            full = np.flatnonzero(np.bincount(row, minlength=len(limit)) >= LISTED)
            most = np.full(len(limit), -np.inf)
            np.maximum.at(most, row, sq)
            limit[full] = np.minimum(limit[full], most[full])
        ids.append(left.ids[i][row])
        others.append(right.ids[col])
        ds.append(_true_distances(left, row + i.start, right, col))
        bounds.append((left.ids[i], np.sqrt(np.maximum(limit - 2 * eps, 0.0))))
    out = [(np.concatenate(ids), np.concatenate(others), np.concatenate(ds)), tuple(map(np.concatenate, zip(*bounds)))] if ids else []
    tables = []
    for c in out:
        n = len(c[0])
        tables.append(pa.table({"id": pa.array(c[0], pa.int64()), "other": pa.array(c[1], pa.int64()) if len(c) == 3 else pa.nulls(n, pa.int64()),
                                "d": pa.array(c[-1], pa.float64()), "work": pa.nulls(n, pa.int64())}))
    return tables, done


def _leaving(left: _Side, right: _Side, width: int) -> tuple[list[pa.Table], int]:
    """Shortest edge of every component on the left to another one on the right within reach; of equal ones the smallest ids."""
    parts, done = [], 0
    eps = _rounding(left, right)
    for i, tiles in _nearest_tiles(left, right, width):
        limit, comps = np.square(left.reach[i]) + eps, left.comps[i]
        for j, least in tiles:
            if least * least > limit.max():
                break
            foreign = comps[:, None] != right.comps[j][None, :]
            if not foreign.any():
                continue
            done += 1
            d = np.where(foreign, _squares(left, i, right, j), np.inf)
            limit = np.minimum(limit, d.min(axis=1))
            r, c = np.nonzero(d <= (limit + 2 * eps)[:, None])
            if not len(r):
                continue
            ids, other = left.ids[i][r], right.ids[j][c]
            parts.append(_first_edges(comps[r], _true_distances(left, r + i.start, right, c + j.start), np.minimum(ids, other),
                                      np.maximum(ids, other), right.comps[j][c]))
    if not parts:
        return [], done
    best = _first_edges(*map(np.concatenate, zip(*parts)))
    cols = dict(zip(("comp", "d", "lo", "hi", "other"), map(pa.array, best)))
    return [pa.table({**cols, "work": pa.nulls(len(best[0]), pa.int64())})], done


def _first_edges(comp, d, lo, hi, other) -> tuple[np.ndarray, ...]:
    order = np.lexsort((hi, lo, d, comp))
    order = order[np.isfinite(d[order])]
    order = order[np.diff(comp[order], prepend=comp[order[:1]] - 1) != 0]
    return comp[order], d[order], lo[order], hi[order], other[order]


_LIST_ROWS = "id bigint, other bigint, d double, work bigint"
_EDGE_ROWS = "comp bigint, d double, lo bigint, hi bigint, other bigint, work bigint"


def _meet(asking: DataFrame, others: DataFrame, parts: tuple[int, int], n_blocks: int, work, schema: str, width: int) -> DataFrame:
    """``work`` on each group of asking points next to each group of others; a point is copied once per group it meets.

    Rows without a key hold the number of block pairs compared.
    """
    n, m = parts
    part = lambda k: F.floor(F.col("block") * k / n_blocks).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asking.select(part(n).alias("l"), every(m).alias("r"), F.lit(True).alias("asks"), "id", "comp", "reach", "block", "vec")
    right = others.select(every(n).alias("l"), part(m).alias("r"), F.lit(False).alias("asks"), "id", "comp",
                          F.lit(float("inf")).alias("reach"), "block", "vec")

    def run(t: pa.Table) -> pa.Table:
        one = _Side(t.filter(t["asks"]), width)
        found, done = work(one, _Side(t.filter(pc.invert(t["asks"])), width, one.origin), width)
        names = [c.split()[0] for c in schema.split(", ")]
        types = {"d": pa.float64()}
        count = pa.table({c: pa.array([done if c == "work" else None], types.get(c, pa.int64())) for c in names})
        return pa.concat_tables([x.select(names) for x in found] + [count])

    return left.unionByName(right).repartition(n * m, "l", "r").groupBy("l", "r").applyInArrow(run, schema)


def _block_reach(placed: DataFrame, width: int) -> DataFrame:
    """Points (id, comp, block, vec) with the distance that holds LISTED other points of their own block."""

    def run(t: pa.Table) -> pa.Table:
        side = _Side(t.append_column("reach", pa.array(np.full(t.num_rows, np.inf))), width)
        reach = np.full(len(side.ids), np.inf)
        if len(reach) > LISTED:
            eps = _rounding(side, side)
            for at in range(0, len(reach), BLOCK_ROWS):
                i = slice(at, at + BLOCK_ROWS)
                d = np.where(side.ids[i][:, None] == side.ids[None, :], np.inf, _squares(side, i, side, slice(None)))
                reach[i] = np.sqrt(np.maximum(np.partition(d, LISTED - 1, axis=1)[:, LISTED - 1], 0.0) + 2 * eps)
        return pa.table([pa.array(side.ids), pa.array(side.comps), t["block"], matrix_list(side.x), pa.array(reach)],
                        names=["id", "comp", "block", "vec", "reach"])

    return placed.select("id", F.col("id").alias("comp"), "block", "vec").groupBy("block").applyInArrow(
        run, "id bigint, comp bigint, block int, vec array<double>, reach double")


def _block_bounds(points: DataFrame, width: int, n_blocks: int) -> DataFrame:
    """(comp, upper): a component in a block of its own has an edge no longer than this to another such block."""
    label = points.groupBy("block").agg(F.min("comp").alias("label"), F.max("comp").alias("_to")).filter("label = _to").drop("_to")
    described = cut_lineage(regions.extents(points, "vec").join(label, "block").select("block", "label", "extent"))

    def kernel(lids, llabels, left, rids, rlabels, right) -> pd.DataFrame:
        far = regions.centre_distances(left, right, width) + left[:, -1][:, None] + right[:, -1][None, :]
        far[llabels[:, None] == rlabels[None, :]] = np.inf
        return pd.DataFrame({"comp": llabels, "upper": far.min(axis=1) * (1 + 1e-9)})

    return regions.block_pairs_by(described, kernel, "comp bigint, upper double", n_blocks).groupBy("comp").agg(F.min("upper").alias("upper"))


_PICK = "min(struct(d, lo, hi, other))"


def _searched(state: DataFrame, labels: DataFrame, bounds: DataFrame, asked: DataFrame, width: int, n_blocks: int, groups: int,
              compared: list | None) -> DataFrame:
    """Edges (comp, d, lo, hi, other) of the components of ``asked`` (comp, reach), the shortest that is not listed among them.

    Only points whose list ends (``bounds``) within the reach of their component may hold one.
    """
    points = cut_lineage(state.drop("comp", "reach").join(labels, "id"))
    wanted = asked if n_blocks == 1 else asked.join(_block_bounds(points, width, n_blocks), "comp", "left").select(
        "comp", F.least("reach", F.coalesce("upper", F.lit(float("inf")))).alias("reach"))
    asking = cut_lineage(points.join(wanted, "comp").join(bounds, "id").filter("bound <= reach").drop("bound"))
    parts = max(1, -(-asking.count() * groups // max(1, points.count())))
    found = cut_lineage(_meet(asking, points, (parts, groups), n_blocks, _leaving, _EDGE_ROWS, width))
    if compared is not None:
        compared.append((found.agg(F.sum("work")).first()[0] or 0, n_blocks * n_blocks))
    forget(asking)
    forget(points)
    return found.filter("comp IS NOT NULL").drop("work")


def minimum_spanning_tree(points: DataFrame, vec: str, id_col: str = "object_id",
                          block_rows: int = BLOCK_ROWS, compared: list | None = None) -> DataFrame:
    """Edges (lo, hi, distance) of the Euclidean minimum spanning tree of points with long ids.

    One pass over the block pairs lists the nearest points of each point, and the distance below which the list is whole.
    Borůvka rounds then read the lists alone: a component joins the other end of its shortest listed edge if no edge that is
    not listed can be shorter. Where that settles too few components, the points of all others but the largest whose lists
    are too short are compared with all points. Points stand in compact blocks of known extent, so blocks that are too far are not compared, and in a fixed
    number of groups up to GROUPS * GROUP_ROWS points, so what is shuffled grows with the points. Of equal vectors only the
    smallest id is compared, the others hang on it. ``compared`` receives (block pairs compared, all block pairs) per pass.
    """
    spark = points.sparkSession
    own = cut_lineage(points.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("vec")))
    if own.count() < 2:
        return spark.createDataFrame([], "lo bigint, hi bigint, distance double")
    width = own.select(F.size("vec")).first()[0]
    equal = cut_lineage(own.groupBy("vec").agg(F.min("id").alias("lo"), F.collect_set("id").alias("all")))
    apart = equal.select(F.col("lo").alias("id"), "vec")
    rows = apart.count()
    placed, n_blocks = regions.compact_blocks(apart, "vec", "id", rows, block_rows)
    state = cut_lineage(_block_reach(placed, width))
    groups = min(n_blocks, max(GROUPS, -(-rows // GROUP_ROWS)))
    lists = cut_lineage(_meet(state, state, (groups, groups), n_blocks, _listed, _LIST_ROWS, width))
    if compared is not None:
        compared.append((lists.agg(F.sum("work")).first()[0] or 0, n_blocks * n_blocks))
    bounds = cut_lineage(lists.filter("id IS NOT NULL AND other IS NULL").groupBy("id").agg(F.min("d").alias("bound")))
    near = lists.filter("other IS NOT NULL").join(bounds, "id").filter("d < bound").select(
        F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi"), "d")
    star = equal.select("lo", F.explode("all").alias("hi"), F.lit(0.0).alias("d")).filter("lo <> hi")
    live = cut_lineage(near.union(star).distinct().select(F.col("lo").alias("lc"), F.col("hi").alias("hc"), "d", "lo", "hi"), lists)
    labels = cut_lineage(own.select("id", F.col("id").alias("comp")).distinct(), own)
    forget(equal)
    inf = F.lit(float("inf"))
    comps = cut_lineage(labels.join(bounds, "id", "left").groupBy("comp").agg(
        F.count("*").alias("n"), F.min(F.coalesce("bound", inf)).alias("bound")))
    edges = None
    while True:
        both = live.select(F.col("lc").alias("comp"), "d", "lo", "hi", F.col("hc").alias("other")).union(
            live.select(F.col("hc").alias("comp"), "d", "lo", "hi", F.col("lc").alias("other")))
        best = both.groupBy("comp").agg(F.expr(_PICK).alias("m"))
        now = cut_lineage(comps.join(best, "comp", "left").select("comp", "n", "bound", "m.*").withColumn(
            "sure", F.coalesce(F.col("d") < F.col("bound"), F.lit(False))))
        total, sure, largest = now.agg(F.count("*"), F.sum(F.col("sure").cast("int")), F.max(F.struct("n", (-F.col("comp")).alias("c")))).first()
        if total < 2:
            break
        picks = now.filter("sure").select("comp", "d", "lo", "hi", "other")
        if 8 * sure < total:
            unsure = now.filter(~F.col("sure") & (F.col("comp") != -largest["c"]))
            found = _searched(state, labels, bounds, unsure.select("comp", F.coalesce("d", inf).alias("reach")), width, n_blocks, groups, compared)
            found = found.union(unsure.filter("d IS NOT NULL").select("comp", "d", "lo", "hi", "other"))
            picks = picks.union(found.groupBy("comp").agg(F.expr(_PICK).alias("m")).select("comp", "m.*"))
        picks = cut_lineage(picks)
        if picks.isEmpty():
            break
        new = picks.select("lo", "hi", F.col("d").alias("distance")).distinct()
        edges = cut_lineage(new if edges is None else edges.union(new).distinct(), edges)
        # the two ends of a mutual edge: the smaller component is the root; so is one that has not picked
        back = picks.select(F.col("comp").alias("other"), F.col("other").alias("_back"))
        joins = picks.join(back, "other", "left").select("comp", F.when(
            (F.col("_back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("parent"))
        roots = _jump(cut_lineage(now.select("comp").join(joins, "comp", "left").select(
            F.col("comp").alias("node"), F.coalesce("parent", "comp").alias("parent"))))
        to = lambda c, out: roots.select(F.col("node").alias(c), F.col("parent").alias(out))
        live = cut_lineage(live.join(to("lc", "_l"), "lc").join(to("hc", "_h"), "hc").filter("_l <> _h").select(
            F.col("_l").alias("lc"), F.col("_h").alias("hc"), "d", "lo", "hi"), live)
        labels = cut_lineage(labels.join(to("comp", "_c"), "comp").select("id", F.col("_c").alias("comp")), labels)
        comps = cut_lineage(now.join(to("comp", "_c"), "comp").groupBy(F.col("_c").alias("comp")).agg(
            F.sum("n").alias("n"), F.min("bound").alias("bound")), comps)
        forget(now)
        forget(picks)
    for step in (state, live, labels, comps, bounds):
        forget(step)
    if edges is None:
        return spark.createDataFrame([], "lo bigint, hi bigint, distance double")
    return edges


def _local_components(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the edges, smallest id that each reaches)."""
    ids, ends = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    one, two = ends[:len(lo)], ends[len(lo):]
    label = np.arange(len(ids))
    while len(one):
        # every component hangs itself on its smallest neighbour, if that is smaller; links end at the smallest of a chain
        parent = np.arange(len(ids))
        np.minimum.at(parent, one, two)
        np.minimum.at(parent, two, one)
        root = _roots(np.arange(len(ids)), parent)
        label, one, two = root[label], root[one], root[two]
        apart = one != two
        one, two = one[apart], two[apart]
    return ids, ids[label]


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over edges (lo, hi) between nodes.

    Each round hangs every component on its smallest neighbour and draws the edges together, which at least halves the
    components that have any; the driver settles the rest when at most LOCAL edges are left.
    """
    spark = nodes.sparkSession
    labels = cut_lineage(nodes.select("id", F.col("id").alias("component")))
    known = labels.select("id").distinct()
    left = cut_lineage(edges.select("lo", "hi").filter("lo <> hi").join(known.withColumnRenamed("id", "lo"), "lo", "left_semi").join(
        known.withColumnRenamed("id", "hi"), "hi", "left_semi").distinct())
    while left.count() > LOCAL:
        both = left.select(F.col("lo").alias("node"), F.col("hi").alias("to")).union(left.select(F.col("hi").alias("node"), F.col("lo").alias("to")))
        roots = _jump(cut_lineage(both.groupBy("node").agg(F.least("node", F.min("to")).alias("parent"))))
        to = lambda c, out: roots.select(F.col("node").alias(c), F.col("parent").alias(out))
        labels = cut_lineage(labels.join(to("component", "_root"), "component", "left").select(
            "id", F.coalesce("_root", "component").alias("component")), labels)
        left = cut_lineage(left.join(to("lo", "_l"), "lo").join(to("hi", "_h"), "hi").filter("_l <> _h").select(
            F.col("_l").alias("lo"), F.col("_h").alias("hi")).distinct(), left)
    t = left.toArrow()
    forget(left)
    if not t.num_rows:
        return labels
    ids, roots = _local_components(t["lo"].to_numpy(), t["hi"].to_numpy())
    moved = spark.createDataFrame(pa.table({"component": ids, "_root": roots}))
    return cut_lineage(labels.join(moved, "component", "left").select("id", F.coalesce("_root", "component").alias("component")), labels)


def single_linkage(points: DataFrame, vec: str, id_col: str = "object_id", **kw) -> DataFrame:
    """MST edges numbered in merge order: (merge_no, lo, hi, distance)."""
    edges = minimum_spanning_tree(points, vec, id_col, **kw)
    return distributed_rank(edges, ["distance", "lo", "hi"]).select(
        (F.col("position") - 1).alias("merge_no"), "lo", "hi", "distance")


def cut_single(points: DataFrame, merges: DataFrame, k: int, id_col: str = "object_id") -> DataFrame:
    """(id, cluster) after all but the last k−1 merges; clusters numbered by their smallest id."""
    n = points.count()
    nodes = points.select(F.col(id_col).cast("bigint").alias("id"))
    labels = connected_components(nodes, merges.filter(F.col("merge_no") < n - k))
    return numbered_components(labels).withColumnRenamed("id", id_col)


def ward_linkage(points: DataFrame, vec: str, id_col: str = "object_id", size_col: str | None = None,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Merges (a, b, distance, size, round) by smallest growth of the error sum of squares.

    The state is one row (id, size, centroid) per cluster: distances follow from
    √(2·nᵢnⱼ/(nᵢ+nⱼ))·‖cᵢ−cⱼ‖, so no distance table exists at any time. Points
    may themselves be centroids of ``size_col`` cells.
    """
    size = F.lit(1) if size_col is None else F.col(size_col)
    state = cut_lineage(points.select(F.col(id_col).cast("bigint").alias("id"), size.cast("bigint").alias("n"),
                                      F.col(vec).alias("vec")))
    left_over = state.count()

    def kernel(lids, sizes, left, rids, rsizes, right) -> pd.DataFrame:
        d = _exact_euclid(left, right)
        ni, nj = sizes[:, None].astype(float), rsizes[None, :].astype(float)
        d = d * np.sqrt(2.0 * ni * nj / (ni + nj))
        d[lids[:, None] == rids[None, :]] = np.inf
        low = d.min(axis=1)
        ties = d == low[:, None]
        lo = np.where(ties, np.minimum(lids[:, None], rids[None, :]), np.iinfo(np.int64).max)
        best = lo.min(axis=1)
        hi = np.where(ties & (lo == best[:, None]), np.maximum(lids[:, None], rids[None, :]), np.iinfo(np.int64).max)
        at = hi.argmin(axis=1)
        return pd.DataFrame({"i": lids, "j": rids[at], "d": low})[np.isfinite(low)]

    merges: list[DataFrame] = []
    while left_over > 1:
        cand = blocked_reduce(state, "id", "vec", "n", kernel, "i bigint, j bigint, d double", block_rows, left_over)
        nn = cut_lineage(cand.groupBy("i").agg(
            F.min(F.struct("d", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "j")).alias("m")).select(
            "i", F.col("m.j").alias("j"), F.col("m.d").alias("d")))
        right = state.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb"))
        left = state.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va"))
        total = F.col("na") + F.col("nb")
        joined = cut_lineage(_reciprocal(nn).join(left, "a").join(right, "b").select(
            "a", "b", "d", total.alias("n"),
            F.zip_with("va", "vb", lambda x, y: (x * F.col("na") + y * F.col("nb")) / total).alias("vec")))
        merges.append(joined.select("a", "b", F.col("d").alias("distance"), F.col("n").alias("size"),
                                    F.lit(len(merges) + 1).alias("round")))
        left_over -= joined.count()
        touched = joined.select(F.explode(F.array("a", "b")).alias("id"))
        state = cut_lineage(state.join(touched, "id", "left_anti").union(
            joined.select(F.col("a").alias("id"), "n", "vec")), state)
    if not merges:
        return points.sparkSession.createDataFrame([], "a bigint, b bigint, distance double, size bigint, round int")
    out = merges[0]
    for m in merges[1:]:
        out = out.union(m)
    return out


def index_groups(heatmap: DataFrame, names: DataFrame) -> DataFrame:
    """Heatmap rows with the ids of ``names`` (id, group_name), zero diagonal."""
    row, col = names.toDF("row_id", "row_group"), names.toDF("col_id", "col_group")
    return heatmap.join(row, "row_group").join(col, "col_group").select(
        "row_id", "col_id", F.when(F.col("row_id") == F.col("col_id"), F.lit(0.0)).otherwise(F.col("distance")).alias("distance"))


def group_merges(heatmap: DataFrame, method: str = "average") -> tuple[DataFrame, DataFrame]:
    """Merges (a, b, distance, size, round) of the groups of a long heatmap whose first row or column is finite, and the
    groups (id, group_name) in order of their names."""
    from cellweave.operators.masks import finite_groups

    # one profile pass; everything after it works on the small map
    heatmap = cut_lineage(heatmap)
    first = heatmap.agg(F.min("row_group")).first()[0]
    kept = cut_lineage(finite_groups(heatmap, first))
    ranked = distributed_rank(kept.select(F.col("row_group").alias("group_name")).distinct(), ["group_name"])
    names = cut_lineage(ranked.select((F.col("position") - 1).alias("id"), "group_name"))
    return table_linkage(index_groups(kept, names), method), names


def group_dendrogram(heatmap: DataFrame, method: str = "average") -> tuple[DataFrame, DataFrame]:
    """Numbered tree (merge_no, left, right, distance, size) of the groups, and the groups (id, group_name)."""
    merges, names = group_merges(heatmap, method)
    return numbered_tree(ordered_merges(merges), names.count()), names


def cut_groups(heatmap: DataFrame, k: int, method: str = "average") -> DataFrame:
    """(group_name, cluster) of the tree cut at k clusters."""
    merges, names = group_merges(heatmap, method)
    return cut_tree(ordered_merges(merges), names, k).join(names, "id").select("group_name", "cluster")
