"""Many clustering models over the same cells: fitted, profiled and mapped together.

A round of all Lloyd fits is one pass over the packed points, whatever their number. One pass over the cells sums the
profiles of all groups and parts under all models and exponents; one job computes all their distances. What grows with
the number of models is the work inside a task, not the number of jobs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.config import SplitConfig
from cellweave.functions.partials import PARTS, block_sums, list_matrix, packed_blocks
from cellweave.functions.scalars import in_fraction, is_finite
from cellweave.functions.vectors import distance_matrix, nearest_rows
from cellweave.model import check_model_size
from cellweave.operators import assign, edf, kmeans, profiles
from cellweave.operators.blocks import pair_rows
from cellweave.operators.validation import eligible_groups
from cellweave.session import cut_lineage

#: Methods whose rounds are means of the nearest points.
LLOYD = ("k-means", "swap-k-means", "lloyd")
#: Methods that ``fit_many`` fits: random centroids take no rounds.
FITTED = (*LLOYD, "random")
#: Doubles of profile sums a task holds before it sends them on.
HELD_VALUES = 4_000_000
#: Separates the parts of a member code; kinds of groups are g(roup), r(andom split), p(replicate) and c(ontrols).
SEP = "\u0001"


@dataclass(frozen=True)
class Spec:
    """Parameters of one clustering: at most ``target`` clusters are left if that is positive."""

    method: str
    k: int
    p: float = 2.0
    discard: int = 0
    target: int = -1


@dataclass
class ModelSet:
    """A model with the exponent of its profiles and the metrics of its maps."""

    centroids: np.ndarray
    p: float
    exp_factor: float
    metrics: tuple[str, ...]


# ---- fits -----------------------------------------------------------------------


def fit_many(points: DataFrame, vec: str, specs: Sequence[Spec], max_iter: int = 300, tol: float = 1e-4, swap_threshold: int = 1,
             id_col: str = "object_id", seed: int = 0) -> dict[Spec, np.ndarray]:
    """Centroids of every spec of FITTED, small clusters discarded and near ones merged, as ``run_clustering`` does singly.

    Farthest-first seeds of k are the first k seeds of any larger number, so each exponent is seeded once, and specs that
    differ in what happens after the rounds share one fit. Random centroids are drawn in the box of the finite points.
    """
    specs = list(dict.fromkeys(specs))
    found: dict[Spec, np.ndarray] = {}
    lloyd, random = [s for s in specs if s.method in LLOYD], [s for s in specs if s.method == "random"]
    if lloyd:
        order = {s: 2.0 if s.method == "swap-k-means" else s.p for s in lloyd}
        seeds = {p: kmeans.farthest_first(points, vec, max(s.k for s in lloyd if order[s] == p), p, id_col)[0] for p in set(order.values())}
        rules = {"k-means": (None, True), "swap-k-means": (swap_threshold, False), "lloyd": (0, False)}
        fits = {(s.method, s.k, order[s]): kmeans.LloydFit(seeds[order[s]][:s.k], order[s], tol, rules[s.method][0], None, rules[s.method][1])
                for s in lloyd}
        kmeans.lloyd_rounds(points, vec, list(fits.values()), max_iter, id_col)
        found |= _cleaned(points, vec, {s: fits[s.method, s.k, order[s]].result.centroids for s in lloyd})
    if random:
        finite = points.filter(F.forall(vec, is_finite)).select(vec)
        width = finite.select(F.size(vec)).first()
        drawn = {k: kmeans.random_centroids(finite, vec, k, width[0] if width else 0, seed) for k in {s.k for s in random}}
        found |= _cleaned(finite, vec, {s: drawn[s.k] for s in random})
    return found


def _cleaned(points: DataFrame, vec: str, found: dict[Spec, np.ndarray]) -> dict[Spec, np.ndarray]:
    """``found`` without the small clusters of each spec, and merged to its target: one pass for the members, one for the sizes."""
    small = [s for s in found if s.discard > 1 or s.target > 0]
    if not small:
        return found
    n = found[small[0]].shape[1]
    blocks = packed_blocks(points, vec)
    many = blocks.rdd.getNumPartitions() > PARTS
    old = [(found[s], s.p) for s in small]
    models = list({(c.tobytes(), p): (c, p) for c, p in old}.values())
    sums = block_sums(blocks, n, lambda x: np.vstack([kmeans.member_sums(x, c, None, p, None) for c, p in models]),
                      sum(len(c) for c, _ in models), n + 3, many)
    own_sums = {(c.tobytes(), p): own for (c, p), own in zip(models, np.split(sums, np.cumsum([len(c) for c, _ in models])[:-1]))}
    kept: dict[Spec, np.ndarray] = {}
    for s, (c, p) in zip(small, old):
        own = own_sums[c.tobytes(), p]
        keep = own[:, n] >= s.discard if s.discard > 1 else np.ones(len(own), dtype=bool)
        if s.discard > 1 and keep.any():
            found[s] = own[keep][:, :n] / own[keep][:, n][:, None]
        else:
            keep[:] = True
        kept[s] = keep
    merged = [s for s in small if 0 < s.target < len(found[s])]
    if merged:
        now = [(old[small.index(s)][0], found[s], kept[s], s.p, s.method in assign.REASSIGN_ALL and s.discard > 1) for s in merged]
        counts = block_sums(blocks, n, lambda x: np.vstack([_sizes(x, *m) for m in now]), sum(len(m[1]) for m in now), 1, many)
        for s, own in zip(merged, np.split(counts, np.cumsum([len(m[1]) for m in now])[:-1])):
            found[s] = assign.merge_nearest_centroids(found[s], own[:, 0].astype(int).tolist(), s.target, s.p)[0]
    return found


def _sizes(x: np.ndarray, before: np.ndarray, after: np.ndarray, kept: np.ndarray, p: float, all_again: bool) -> np.ndarray:
    """Members of the clusters that stay, once the points of the others went to the nearest of them."""
    best = nearest_rows(x, before, p)[0]
    own, lost = (np.cumsum(kept) - 1)[best], ~kept[best]
    near = nearest_rows(x, after, p)[0]
    return np.bincount(np.where(lost | all_again, near, own), minlength=len(after))[:, None].astype(float)


# ---- profiles -------------------------------------------------------------------


def member_codes(cells: DataFrame, group: str, replicate: str, controls: Sequence[str], splits: SplitConfig, seed_key: str) -> DataFrame:
    """``cells`` with the codes of all groups and parts that a cell belongs to: its group, the random splits and the
    replicate of an eligible group, and its control treatment and replicate. Only the eligible groups are joined."""
    keep = eligible_groups(cells, group, splits.penetrance_threshold).select(F.col(group).alias("_group"), F.lit(True).alias("_eligible"))
    joined = cells.join(keep, cells[group].eqNullSafe(keep["_group"]), "left")
    name, part = F.coalesce(F.col(group).cast("string"), F.lit("")), F.coalesce(F.col(replicate).cast("string"), F.lit(""))

    def code(kind: str, outer: Column, inner: Column) -> Column:
        return F.concat(F.lit(kind + SEP), outer, F.lit(SEP), inner)

    codes = [code("g", F.lit(""), name), F.when(F.col("_eligible"), code("p", name, part)),
             F.when(F.col(group).isin(list(controls)), code("c", F.lit(""), F.concat(name, F.lit("_"), part)))]
    codes += [F.when(F.col("_eligible") & in_fraction(seed_key, splits.seed + i, splits.random_fraction), code("r", name, F.lit(str(i))))
              for i in range(splits.random_splits)]
    return joined.withColumn("codes", F.filter(F.array(*codes), lambda c: c.isNotNull())).drop("_group", "_eligible")


def _similarities(d: np.ndarray) -> np.ndarray:
    """1/d; a cell on a centroid counts for that centroid alone."""
    on = (d == 0).any(axis=1)
    out = 1.0 / d
    out[on] = d[on] == 0
    return out


def _scaled(m: np.ndarray) -> np.ndarray:
    return m / m.sum(axis=1, keepdims=True)


def _encoded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(points, row of each membership, number of its code, codes) of a batch (vec, codes)."""
    x = list_matrix(batch.column(0))
    lists = batch.column(1)
    flat = lists.flatten().dictionary_encode()
    rows = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy()))
    return x, rows, flat.indices.to_numpy(), flat.dictionary.to_pylist()


def _group_tops(members: DataFrame, vec: str, models: list[tuple[np.ndarray, float]]) -> dict[str, np.ndarray]:
    """Largest similarity to any centroid of each model within each group or part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x, rows, at, names = _encoded(batch)
                with np.errstate(divide="ignore"):
                    best = np.stack([_similarities(distance_matrix(x, c, p)).max(axis=1) for c, p in models], axis=1)[rows]
                top = np.full((len(names), len(models)), -np.inf)
                np.maximum.at(top, at, best)
                for name, own in zip(names, top):
                    held[name] = np.maximum(held[name], own) if name in held else own
        for name, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], names=["code", "model", "top"])

    found = members.select(vec, "codes").mapInArrow(run, "code string, model int, top double").groupBy("code", "model").agg(F.max("top").alias("top"))
    out: dict[str, np.ndarray] = {}
    found = cut_lineage(found)
    check_model_size(found.count(), "largest similarities of groups")
    for r in found.collect():
        out.setdefault(r["code"], np.zeros(len(models)))[r["model"]] = r["top"]
    return out


def profile_many(members: DataFrame, vec: str, sets: Sequence[ModelSet]) -> DataFrame:
    """(set, kind, outer, inner, n, profile) of all groups and parts under every model set, in one pass over ``members``.

    Exponents above 0 need the largest similarity of each group first, which is one more pass for all sets.
    """
    check_model_size(sum(s.centroids.size for s in sets), "centroids")
    models = [(s.centroids, s.p) for s in sets]
    deltas = [profiles.smallest_centroid_distance(c, p) if s.exp_factor < 0 else 0.0 for s, (c, p) in zip(sets, models)]
    sharp = [i for i, s in enumerate(sets) if s.exp_factor > 0]
    tops = _group_tops(members, vec, [models[i] for i in sharp]) if sharp else {}
    factors = [s.exp_factor for s in sets]
    ends = np.cumsum([len(c) for c, _ in models])
    shared = members.sparkSession.sparkContext.broadcast((models, deltas, factors, sharp, tops))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models_, deltas_, factors_, sharp_, tops_ = shared.value
        held: dict[str, list] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for name, (n, flat) in held.items():
                own = np.split(flat, ends[:-1])
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(own)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array([n] * len(own), pa.int64()),
                    pa.array([list(v) for v in own], pa.list_(pa.float64()))], names=["code", "set", "n", "sums"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            x, rows, at, names = _encoded(batch)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            sums = np.zeros((len(names), ends[-1]))
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                for i, (c, p) in enumerate(models_):
                    d = distance_matrix(x, c, p)
                    if factors_[i] > 0:
                        top = np.array([tops_[name][sharp_.index(i)] for name in names])
                        s = _similarities(d)[rows] / top[at][:, None]
                        m = _scaled((np.exp(factors_[i] * s) - 1.0) / (np.exp(factors_[i]) - 1.0))
                    else:
                        m = _scaled(np.exp(-d / deltas_[i]) if factors_[i] < 0 else _similarities(d))[rows]
                    if len(first):
                        sums[:, ends[i] - len(c):ends[i]] = np.add.reduceat(m[order], first, axis=0)
            counts = np.bincount(at, minlength=len(names))
            for name, n, own in zip(names, counts.tolist(), sums):
                if name in held:
                    held[name][0] += n
                    held[name][1] = held[name][1] + own
                else:
                    held[name] = [n, own]
            if len(held) * int(ends[-1]) > HELD_VALUES:
                yield from sent()
        yield from sent()

    partial = members.select(vec, "codes").mapInArrow(run, "code string, set int, n bigint, sums array<double>")
    bins = partial.select("code", "set", "n", F.posexplode("sums").alias("bin", "v")).groupBy("code", "set", "bin").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v"))
    whole = bins.groupBy("code", "set").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("bin", "v"))).alias("b"))
    soft = F.col("set").isin([i for i, f in enumerate(factors) if f < 0])
    part = F.split("code", SEP)
    return whole.select(
        "set", part[0].alias("kind"), part[1].alias("outer"), part[2].alias("inner"), "n",
        F.transform("b", lambda b: F.when(soft, b["v"] / F.col("n")).otherwise(b["v"])).alias("profile"))


# ---- maps -----------------------------------------------------------------------


def profile_gaps(p: np.ndarray, q: np.ndarray, metric: str, similarity: np.ndarray | None = None, m: float = 1.0) -> np.ndarray:
    """Distance of each row of p to the same row of q; the metrics of ``profiles.profile_distance`` in batches."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "summed_minmax":
            return 1.0 - (np.minimum(p, q) ** 2).sum(axis=1) / (np.maximum(p, q) ** 2).sum(axis=1)
        if metric == "l2_norm":
            return np.sqrt(((p - q) ** 2).sum(axis=1))
        if metric in ("l1_norm", "summed_difference"):
            return np.abs(p - q).sum(axis=1)
        if metric in ("chi1_norm", "chi2_norm"):
            top = np.abs(p - q) if metric == "chi1_norm" else (p - q) ** 2
            return np.where((p == 0) & (q == 0), 0.0, top / (p + q)).sum(axis=1)
        if metric == "quadratic_chi":
            a = np.eye(p.shape[1]) if similarity is None else similarity
            d = (p + q) ** m @ a ** m
            z = np.where(d == 0, 0.0, (p - q) / d)
            return np.einsum("ni,ij,nj->n", z, a, z)
    raise ValueError(f"no such profile metric: {metric}")


def distance_many(found: DataFrame, sets: Sequence[ModelSet]) -> DataFrame:
    """(set, metric, kind, outer, row_group, col_group, distance), row_group > col_group, of all profiles within a kind and group."""
    wanted = {i: [m for m in s.metrics if m != profiles.EDF_METRIC] for i, s in enumerate(sets)}
    similar = {i: profiles.bin_similarity(s.centroids, s.p, batch=True) for i, s in enumerate(sets) if "quadratic_chi" in s.metrics}
    check_model_size(sum(a.size for a in similar.values()), "similarities of bins")
    shared = found.sparkSession.sparkContext.broadcast((wanted, similar))
    norm = profiles.normalise_profiles(found)
    keys = ["set", "kind", "outer"]
    pairs = pair_rows(norm.select(*keys, F.col("inner").alias("row_group"), F.col("profile").alias("p")),
                      norm.select(*keys, F.col("inner").alias("col_group"), F.col("profile").alias("q")),
                      "row_group", "col_group", on=keys, condition=F.col("row_group") > F.col("col_group"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted_, similar_ = shared.value
        for batch in batches:
            numbers = batch.column("set").to_numpy()
            for i in np.unique(numbers):
                own = batch.filter(pa.array(numbers == i))
                p, q = list_matrix(own.column("p")), list_matrix(own.column("q"))
                for metric in wanted_[int(i)]:
                    yield pa.RecordBatch.from_arrays(
                        [own.column("set"), pa.array([metric] * own.num_rows), *(own.column(c) for c in ("kind", "outer", "row_group", "col_group")),
                         pa.array(profile_gaps(p, q, metric, similar_.get(int(i))))],
                        names=["set", "metric", "kind", "outer", "row_group", "col_group", "distance"])

    return pairs.select(*keys, "row_group", "col_group", "p", "q").mapInArrow(
        run, "set int, metric string, kind string, outer string, row_group string, col_group string, distance double")


def edf_many(members: DataFrame, vec: str) -> DataFrame:
    """(kind, outer, row_group, col_group, distance) by KS distances of all features, weighted by their agreement between groups.

    No model takes part, so this is computed once for all sets; the distances between groups, which the weights come from,
    are among those of all kinds.
    """
    part = F.split("code", SEP)
    rows = members.select(vec, F.explode("codes").alias("code")).select(vec, part[0].alias("kind"), part[1].alias("outer"), part[2].alias("inner"))
    pairs, names = edf.group_pairs(rows, ["kind", "outer"], "inner", vec)
    pairs = cut_lineage(pairs)
    weights = cut_lineage(edf.edf_weights(pairs.filter("kind = 'g'")))
    return edf.weighted_distances(pairs, names, ["kind", "outer"], weights)


def qualities(distances: DataFrame, found: DataFrame) -> DataFrame:
    """Per (set, metric): mean distance between groups (``between``), and between the random splits, the replicates and the
    controls; ``quality`` of the map with the random distances on its diagonal (zeros unless every group has one),
    ``random_quality`` and ``replicate_quality`` with the mean of those there are."""
    groups = found.filter("kind = 'g'").groupBy("set").agg(F.count("*").alias("n_groups"))
    inner = distances.groupBy("set", "metric", "kind", "outer").agg(F.avg("distance").alias("d"))

    def mean(kind: str) -> Column:
        return F.avg(F.when(F.col("kind") == kind, F.col("d")))

    per = inner.groupBy("set", "metric").agg(
        mean("g").alias("between"), mean("r").alias("random"), mean("p").alias("replicate"), mean("c").alias("controls"),
        F.sum((F.col("kind") == "r").cast("bigint")).alias("n_random"))
    diagonal = F.when(F.col("n_random") == F.col("n_groups"), F.col("random")).otherwise(F.lit(0.0))
    return per.join(groups, "set").select(
        "set", "metric", (F.col("between") - diagonal).alias("quality"), (F.col("between") - F.col("random")).alias("random_quality"),
        (F.col("between") - F.col("replicate")).alias("replicate_quality"), F.col("controls").alias("control_distance"))
