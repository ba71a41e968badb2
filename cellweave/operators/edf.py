"""Two-sample distances between empirical distribution functions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions.scalars import MODULUS, fraction_limit
from cellweave.functions.vectors import total
from cellweave.model import check_model_size
from cellweave.operators.blocks import pair_rows
from cellweave.operators.order_stats import running_totals
from cellweave.session import cut_lineage


def _sup_difference(counts: DataFrame, keys: Sequence[str], value: str, n1: str, n2: str) -> DataFrame:
    """max |F1 − F2| from per-value counts of both samples (already one row per key and value)."""
    run = running_totals(counts, keys, [value], {"_c1": F.col(n1), "_c2": F.col(n2)})
    totals = counts.groupBy(*keys).agg(F.sum(n1).alias("_t1"), F.sum(n2).alias("_t2"))
    if keys:
        joined = run.join(totals, list(keys))
    else:
        t = totals.first()
        joined = run.withColumns({"_t1": F.lit(t[0]), "_t2": F.lit(t[1])})
    gap = F.abs(F.col("_c1") / F.col("_t1") - F.col("_c2") / F.col("_t2"))
    ok = (F.col("_t1") > 0) & (F.col("_t2") > 0)
    return joined.groupBy(*keys).agg(
        F.max(F.when(ok, gap).otherwise(F.lit(float("nan")))).alias("ks"),
        F.first("_t1").alias("n1"), F.first("_t2").alias("n2"))


def ks_by_feature(long: DataFrame, in_first: Column, in_second: Column,
                  keys: Sequence[str] = ("feature",)) -> DataFrame:
    """KS distance of two samples per feature. ``long`` is (…, feature, value); samples may overlap.

    Equal values are merged by a combining aggregate first, so ties are exact and
    the accumulation runs over distinct values in range partitions.
    """
    counts = long.groupBy(*keys, "value").agg(
        F.sum(in_first.cast("bigint")).alias("_n1"), F.sum(in_second.cast("bigint")).alias("_n2"))
    return _sup_difference(counts, list(keys), "value", "_n1", "_n2")


#: Doubles a kernel compares at once.
KS_VALUES = 1 << 20


class _PairMaxima:
    """Running maxima of F_i − F_j over the values of one key, which come in order.

    F_i − F_j can only rise at a value of group i, so each row is compared with the other groups once: the work is rows
    times groups, not values times pairs.
    """

    def __init__(self, groups: np.ndarray, sizes: np.ndarray, before: np.ndarray):
        self.groups, self.sizes, self.count = groups, sizes.astype(float), before.astype(float)
        start = self.count / self.sizes
        self.top = start[:, None] - start[None, :]

    def add(self, place: np.ndarray, group: np.ndarray, count: np.ndarray) -> None:
        """Rows (number of the value from 0 on, position of the group, count), ordered by value; no value is cut in two."""
        f = np.zeros((int(place[-1]) + 1, len(self.groups)))
        f[place, group] = count
        np.cumsum(f, axis=0, out=f)
        f += self.count
        self.count = f[-1].copy()
        f /= self.sizes
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        rows = f[place[order]]
        gaps = rows[np.arange(len(order)), group[order]][:, None] - rows
        own = group[order][first]
        self.top[own] = np.maximum(self.top[own], np.maximum.reduceat(gaps, first, axis=0))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.triu_indices(len(self.groups), 1)
        return self.groups[i], self.groups[j], np.maximum(self.top, self.top.T)[i, j]


def _maxima(v: np.ndarray, g: np.ndarray, c: np.ndarray, n: np.ndarray, before: dict[int, tuple[int, int]]) -> _PairMaxima:
    """Maxima over the rows (value, group, count, size of the group) of one key; ``before``: group → (count, size) so far."""
    groups = np.unique(np.concatenate([g, np.fromiter(before, dtype=g.dtype, count=len(before))]))
    at = np.searchsorted(groups, g)
    sizes, held = np.ones(len(groups)), np.zeros(len(groups))
    sizes[at] = n
    for name, (count, size) in before.items():
        k = np.searchsorted(groups, name)
        held[k], sizes[k] = count, size
    out = _PairMaxima(groups, sizes, held)
    fresh = np.concatenate([[True], (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))])
    starts = np.append(np.flatnonzero(fresh), len(v))
    number = np.cumsum(fresh) - 1
    step, lo = max(1, KS_VALUES // len(groups)), 0
    while lo < len(starts) - 1:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + step, side="right")) - 1)
        rows = slice(starts[lo], starts[hi])
        out.add(number[rows] - lo, at[rows], c[rows])
        lo = hi
    return out


def ks_pairs(rows: DataFrame, keys: Sequence[str], group: str = "g", value: str = "value") -> DataFrame:
    """(keys…, i, j, ks): largest gap between the EDFs of every two groups (ints, i < j) that a key holds.

    Equal values of a group combine first. The counts are range-partitioned by (keys, value), so a key with a third of all
    values spreads over many tasks; only the key a partition begins with has values before it, and how many of each group
    these are is sent along (partitions times groups numbers, checked). One kernel per partition returns the maxima of all
    pairs. NULL values and groups are left out, NaN is the largest value; keys are not NULL.
    """
    spark, keys = rows.sparkSession, list(keys)
    counts = cut_lineage(rows.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(
        *keys, F.col(value).cast("double").alias("_v"), F.col(group).cast("int").alias("_g")).agg(F.count("*").alias("_c")))
    sizes = counts.groupBy(*keys, "_g").agg(F.sum("_c").alias("_n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The borders are sampled: fix them before they are used twice.
    ranged = cut_lineage(counts.join(sizes, [*keys, "_g"]).repartitionByRange(parts, *keys, "_v").withColumn("_pid", F.spark_partition_id()), counts)
    sums = cut_lineage(ranged.groupBy(*keys, "_g", "_pid").agg(F.sum("_c").alias("_c"), F.first("_n").alias("_n")))
    check_model_size(2 * parts * (1 + (sums.agg(F.max("_g")).first()[0] or 0)), "EDF counts at the borders of partitions")
    several = sums.groupBy(*keys).agg(F.count_distinct("_pid").alias("_p")).filter("_p > 1").drop("_p")
    before: dict[tuple, dict[int, tuple[int, int]]] = {}
    now, upto = None, {}
    for r in sums.join(several, keys, "left_semi").orderBy(*keys, "_pid").collect():
        key, at = tuple(r[k] for k in keys), (r["_pid"], *(r[k] for k in keys))
        if key != now:
            now, upto = key, {}
        if at not in before:
            before[at] = dict(upto)
        upto[r["_g"]] = (upto.get(r["_g"], (0, 0))[0] + r["_c"], r["_n"])
    shared = spark.sparkContext.broadcast(before)
    names = ["_pid", *keys]
    schema = T.StructType([ranged.schema[k] for k in keys] + [
        T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("ks", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[pa.RecordBatch] = []
        key: tuple | None = None

        def finished() -> Iterator[pa.RecordBatch]:
            if gathered:
                t = pa.Table.from_batches(gathered)
                v, g, c, n = (t.column(x).to_numpy() for x in ("_v", "_g", "_c", "_n"))
                i, j, ks = _maxima(v, g, c, n, shared.value.get(key, {})).result()
                if len(ks):
                    columns = [pa.array([x] * len(ks), type=t.schema.field(k).type) for k, x in zip(keys, key[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(ks)], names=[*keys, "i", "j", "ks"])

        for batch in batches:
            new = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
            for x in names:
                column = batch.column(x)
                new |= pc.not_equal(column.slice(1), column.slice(0, max(batch.num_rows - 1, 0))).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for s, e in zip(edges, edges[1:]):
                own = tuple(batch.column(x)[s].as_py() for x in names)
                if own != key:
                    yield from finished()
                    gathered, key = [], own
                gathered.append(batch.slice(s, e - s))
        yield from finished()

    ordered = ranged.repartition(parts, "_pid").sortWithinPartitions(*names, "_v", "_g").select(*names, "_v", "_g", "_c", "_n")
    return ordered.mapInArrow(run, schema).groupBy(*keys, "i", "j").agg(F.max("ks").alias("ks"))


def numbered(df: DataFrame, group: str, groups: Sequence, name: str = "g") -> DataFrame:
    """Adds the position of each row's group in ``groups``; rows of other groups go."""
    names = df.sparkSession.createDataFrame(list(enumerate(groups)), T.StructType([
        T.StructField(name, T.IntegerType()), T.StructField(group, df.schema[group].dataType)]))
    return df.join(names, group)


def pairwise_ks(long: DataFrame, group: str, groups: Sequence) -> DataFrame:
    """KS distance of every pair of groups for every feature: (feature, group_i, group_j, ks), i < j.

    A pair of which a group has no value of a feature is NaN there. The data are ranged once for all pairs and no group
    is ever paired row by row.
    """
    names = list(groups)
    check_model_size(len(names), "groups")
    found = ks_pairs(numbered(long, group, names), ["feature"])
    left = long.sparkSession.createDataFrame(list(enumerate(names)), T.StructType([
        T.StructField("i", T.IntegerType()), T.StructField("group_i", long.schema[group].dataType)]))
    every = pair_rows(left, left.toDF("j", "group_j"), "i", "j", condition=F.col("i") < F.col("j"))
    # one row per feature and pair, as in the result
    features = found.select("feature").distinct().withColumn("_one", F.lit(1))
    frame = every.withColumn("_one", F.lit(1)).join(features, "_one").drop("_one")
    return frame.join(found, ["feature", "i", "j"], "left").select(
        "feature", "group_i", "group_j", F.coalesce("ks", F.lit(float("nan"))).alias("ks"))


def edf_weights(pair_ks: DataFrame) -> DataFrame:
    """Per feature: mean off-diagonal KS; weight = max − mean, scaled to unit length."""
    means = pair_ks.groupBy("feature").agg(F.avg("ks").alias("mean_ks"))
    top = means.agg(F.max("mean_ks")).first()[0]
    gaps = means.withColumn("_w", F.lit(top) - F.col("mean_ks"))
    norm = gaps.agg(F.sqrt(F.sum(F.col("_w") * F.col("_w")))).first()[0]
    w = F.col("_w") / F.lit(norm) if norm else F.lit(float("nan"))
    return gaps.select("feature", "mean_ks", w.alias("weight"))


def edf_distance_matrix(pair_ks: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """√Σ(w·KS)² over features for every pair of groups, both directions."""
    src = pair_ks
    ks = F.col("ks")
    if weights is not None:
        src = src.join(weights.select("feature", "weight"), "feature")
        ks = ks * F.col("weight")
    half = src.groupBy("group_i", "group_j").agg(F.sqrt(F.sum(ks * ks)).alias("distance"))
    mirror = half.select(F.col("group_j").alias("group_i"), F.col("group_i").alias("group_j"), "distance")
    return half.union(mirror)


def group_pairs(rows: DataFrame, keys: Sequence[str], name: str, vec: str) -> tuple[DataFrame, list[str]]:
    """(keys…, feature, i, j, ks) between the groups of a key, and the names of the groups i and j, which are strings."""
    names = [r[0] for r in rows.filter(F.col(name).isNotNull()).select(name).distinct().orderBy(name).collect()]
    check_model_size(len(names), "groups")
    long = numbered(rows.select(*keys, F.col(name).alias("_name"), F.posexplode(vec).alias("feature", "value")), "_name", names)
    return ks_pairs(long, [*keys, "feature"]), names


def weighted_distances(pairs: DataFrame, names: Sequence[str], keys: Sequence[str], weights: DataFrame | None = None) -> DataFrame:
    """(keys…, row_group, col_group, distance), row_group > col_group: √Σ(w·KS)² over the features of ``group_pairs``."""
    gap = F.col("ks")
    if weights is not None:
        pairs, gap = pairs.join(weights.select("feature", "weight"), "feature"), F.col("ks") * F.col("weight")
    half = pairs.groupBy(*keys, "i", "j").agg(F.sqrt(F.sum(gap * gap)).alias("distance"))
    left = pairs.sparkSession.createDataFrame(list(enumerate(names)), "i int, col_group string")
    return half.join(left, "i").join(left.toDF("j", "row_group"), "j").select(*keys, "row_group", "col_group", "distance")


def group_distances(rows: DataFrame, keys: Sequence[str], name: str, vec: str, weights: DataFrame | None = None) -> DataFrame:
    """(keys…, row_group, col_group, distance), row_group > col_group: √Σ(w·KS)² over the features between the groups of a key.

    Groups are strings; their number is that of a map. Without ``weights`` (feature, weight) every feature counts alike.
    """
    pairs, names = group_pairs(rows, list(keys), name, vec)
    return weighted_distances(pairs, names, list(keys), weights)


def agreement_weights(rows: DataFrame, name: str, vec: str) -> DataFrame:
    """(feature, mean_ks, weight) from the KS distances of all groups: features on which groups agree weigh most."""
    names = [r[0] for r in rows.filter(F.col(name).isNotNull()).select(name).distinct().orderBy(name).collect()]
    long = rows.select(F.col(name).alias("_name"), F.posexplode(vec).alias("feature", "value"))
    return edf_weights(cut_lineage(ks_pairs(numbered(long, "_name", names), ["feature"])))


def kolmogorov_p(ks: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value with the small-sample correction of the effective size."""
    en = F.sqrt(n1 * n2 / (n1 + n2))
    lam = (en + F.lit(0.12) + F.lit(0.11) / en) * ks
    series = total([
        F.lit(2.0 * (-1.0) ** (j - 1)) * F.exp(F.lit(-2.0 * j * j) * lam * lam) for j in range(1, terms + 1)])
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def ks_against(df: DataFrame, group: str, reference, value: str, groups: Sequence) -> DataFrame:
    """KS distance and p-value of each group against the reference group."""
    long = df.select(F.col(group), F.lit(value).alias("feature"), F.col(value).cast("double").alias("value"))
    others = [g for g in groups if g != reference]
    tests = F.array(*[F.lit(g) for g in others])
    spread = long.select("value", F.col(group).alias("_g"), F.explode(
        F.when(F.col(group) == F.lit(reference), tests).otherwise(F.array(F.col(group)))).alias("group_name"))
    spread = spread.filter(F.col("group_name").isin(others))
    out = ks_by_feature(
        spread, F.col("_g") == F.lit(reference), F.col("_g") == F.col("group_name"), keys=["group_name"])
    return out.withColumn("p_value", kolmogorov_p(F.col("ks"), F.col("n1"), F.col("n2")))


def bootstrap_count(n: int, fraction: float = 0.1, limit: int = 200) -> int:
    """Pairs of resamples for n control cells: a tenth, rounded half up, at most ``limit``."""
    return int(min(math.floor(fraction * n + 0.5), limit))


class _Resamples:
    """Membership of keys in 2·b seeded resamples; column 2·i + half is half ``half`` of pair i. Runs inside tasks."""

    def __init__(self, b: int, part: float, seed: int):
        seeds = np.array([seed + 2 * i + half for i in range(b) for half in (0, 1)], dtype=np.int64)
        self.b, self.shift, self.limit = b, seeds * 1013904223 % MODULUS, fraction_limit(part)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        v = (keys[:, None] % MODULUS + self.shift[None, :]) % MODULUS
        return (v * v % MODULUS * 48271 + v) % MODULUS < self.limit


def resample_ks(rows: DataFrame, feature: str, value: str, key: str, b: int, part: float, seed: int) -> DataFrame:
    """(feature, b, ks): KS distance of the two halves of each pair of resamples, NaN if one is empty.

    Rows are ranged by (feature, value) once; what runs along is a vector of 2·b counts, and no row is copied for the
    resamples it belongs to. A first pass counts each partition, so that the second knows what came before and in all.
    """
    check_model_size(2 * b, "resamples")
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema[feature].dataType
    clean = rows.filter(F.col(value).isNotNull()).select(F.col(feature).alias("_f"), F.col(value).cast("double").alias("_v"), (F.col(key) % MODULUS).alias("_k"))
    ranged = cut_lineage(clean.repartitionByRange(parts, "_f", "_v").withColumn("_pid", F.spark_partition_id()))
    member = _Resamples(b, part, seed)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list = []
        for batch in batches:
            kinds = [batch.column("_f").type]
            own = batch.column("_f").dictionary_encode()
            code, pid = own.indices.to_numpy(), batch.column("_pid").to_numpy()
            names = own.dictionary.to_pylist()
            inside = member(batch.column("_k").to_numpy())
            for c in np.unique(code):
                for n in np.unique(pid[code == c]):
                    at = (int(n), names[c])
                    held[at] = held.get(at, 0) + inside[(code == c) & (pid == n)].sum(axis=0)
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], kinds[0]), pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64()))],
                names=["_pid", "_f", "counts"])

    counts = ranged.mapInArrow(counted, T.StructType([
        T.StructField("_pid", T.IntegerType()), T.StructField("_f", kind), T.StructField("counts", T.ArrayType(T.LongType()))]))
    before: dict[tuple, np.ndarray] = {}
    whole: dict = {}
    per: dict[tuple, np.ndarray] = {}
    counts = cut_lineage(counts)
    check_model_size(counts.count() * 2 * b, "resample counts of partitions")
    for r in counts.collect():
        at = (r["_f"], r["_pid"])
        per[at] = per.get(at, 0) + np.array(r["counts"], dtype=np.int64)
    for f, pid in sorted(per):
        before[pid, f] = whole.get(f, np.zeros(2 * b, dtype=np.int64))
        whole[f] = before[pid, f] + per[f, pid]
    shared = spark.sparkContext.broadcast((before, whole))
    schema = T.StructType([T.StructField("feature", kind), T.StructField("b", T.IntegerType()), T.StructField("ks", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before_, whole_ = shared.value
        now, f_type = None, None
        held = top = tail = None  # counts so far, largest gaps, and the EDFs' gaps at the last value seen

        def finished() -> Iterator[pa.RecordBatch]:
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now[1]] * b, f_type), pa.array(np.arange(b, dtype=np.int32)), pa.array(np.maximum(top, tail))], names=["feature", "b", "ks"])

        for batch in batches:
            f_type = batch.column("_f").type
            own = batch.column("_f").dictionary_encode()
            code, names = own.indices.to_numpy(), own.dictionary.to_pylist()
            pid, v, k = (batch.column(c).to_numpy() for c in ("_pid", "_v", "_k"))
            cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(pid) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(v)]):
                if s == e:
                    continue
                at = (int(pid[s]), names[code[s]])
                if at != now:
                    yield from finished()
                    now, held, last = at, before_[at].copy(), None
                    top, tail = np.zeros(b), np.zeros(b)
                for lo in range(int(s), int(e), 2048):
                    x = v[lo:min(lo + 2048, int(e))]
                    run_ = held + np.cumsum(member(k[lo:lo + len(x)]), axis=0)
                    share = run_ / np.maximum(whole_[at[1]], 1)
                    gap = np.abs(share[:, 0::2] - share[:, 1::2])
                    # A gap counts where a value ends; whether the last one does, the next rows say.
                    ends = np.append((x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1])), False)
                    if last is not None and not (last == x[0] or np.isnan(last) and np.isnan(x[0])):
                        top = np.maximum(top, tail)
                    if ends.any():
                        top = np.maximum(top, gap[ends].max(axis=0))
                    held, tail, last = run_[-1], gap[-1], x[-1]
        yield from finished()

    found = ranged.repartition(parts, "_pid").sortWithinPartitions("_pid", "_f", "_v").mapInArrow(run, schema)
    empty = spark.createDataFrame(
        [(f, i) for f, n in whole.items() for i in range(b) if not n[2 * i] or not n[2 * i + 1]], T.StructType([schema["feature"], schema["b"]]))
    most = found.groupBy("feature", "b").agg(F.max("ks").alias("ks"))
    none = empty.withColumn("_none", F.lit(True))
    return most.join(none, ["feature", "b"], "left").select("feature", "b", F.when(F.col("_none"), F.lit(float("nan"))).otherwise(F.col("ks")).alias("ks"))


def bootstrap_quality(long: DataFrame, control: str, treated: str, seed_key: str, b: int | None = None,
                      part: float = 0.2, seed: int = 11) -> DataFrame:
    """Per feature: KS(control, treated) minus the mean KS of b pairs of control resamples, by default ``bootstrap_count``
    of the control cells.

    Resample membership is a seeded hash of the row: a control cell appears only in the resamples it belongs to.
    """
    main = ks_by_feature(long, F.col(control), F.col(treated)).select("feature", F.col("ks").alias("ks_treated"))
    cells = long.filter(F.col(control))
    if b is None:
        most = cells.groupBy("feature").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
        b = bootstrap_count(most or 0)
    boot = resample_ks(cells, "feature", "value", seed_key, b, part, seed)
    means = boot.groupBy("feature").agg(F.avg("ks").alias("ks_bootstrap"))
    return main.join(means, "feature").withColumn("quality", F.col("ks_treated") - F.col("ks_bootstrap"))


def best_features(quality: DataFrame, n: int, score: str = "quality") -> DataFrame:
    """Top n features by score (ties by name); n ≤ 0 keeps all. One row per feature goes in."""
    ranked = quality.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "feature")))
    return ranked if n <= 0 else ranked.filter(F.col("rank") <= n)
