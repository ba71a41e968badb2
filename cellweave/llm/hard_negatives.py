"""Hard negatives by anchor spanning-tree bounds.

An anchor's hard negatives are rows of other labels that score close below its positives. Anchors are gathered into
chunks of one label, near ones together, and each chunk gets its minimum spanning tree by Euclidean distance. A row x
scores ``a · x`` with a child anchor and ``p · x`` with its parent, and ``|a · x - p · x| <= |a - p| |x|``: what is known of
the parent's score bounds the child's. Only rows whose bounds overlap the child's window are scored again; for the others
the bounds, wider by one more edge, go on to the grandchildren.

Rows are dealt into blocks once, by a hash of their number, so copies spread evenly, and never copied. Anchors, which are
few, go to every block and stream past it in tree order; a task holds one block and one chunk. Every block returns its
best rows of each window at most. One block in ``SEED_EVERY`` is searched first: the k-th best score found there can only
rise, so it closes the windows of all other blocks from below, and the rows sent on stay near ``SEED_EVERY * k`` for each
window however many blocks there are.

The same search finds the positives: rows of the anchor's own label, in a window without limits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.partials import list_matrix
from cellweave.llm.common import batch_of
from cellweave.session import forget, stored

#: Rows of a block, rows scored at once, anchors of a chunk.
BLOCK, SLAB, CHUNK = 65_536, 4_096, 256
#: One block in so many is searched first.
SEED_EVERY = 32
#: Components whose signs order the anchors of a label.
SIGNS = 12
#: Bounds are this much wider than computed, for rounding.
SLACK = 1e-9
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
#: Above this share of overlapping rows an anchor's scores are computed in one product.
DENSE = 0.2


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, v, label) of the rows with an id, a label and a vector of finite components, of the commonest dimension."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"), F.col(label_col).cast("bigint").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter("vec_id is not null and label is not null and v is not null and size(v) > 0").filter(F.coalesce(finite, F.lit(False)))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (dims["d"] if dims else 0))


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as doubles where these hold the integers exactly, else as Python integers."""
    top = np.abs(x).max(initial=0.0)
    if top * scale < 2.0 ** 52:
        return np.floor(x * scale)
    whole = [[int(v) * scale if abs(v) >= 2.0 ** 52 else math.floor(v * scale) for v in row] for row in x.tolist()]
    return np.array(whole, dtype=object)


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a with those of x, held within the range of a bigint."""
    if a.dtype != object and x.dtype != object:
        if np.abs(a).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(a.shape[1], 1) < 2.0 ** 53:
            return a @ x.T
        a, x = (np.array([[int(v) for v in row] for row in m.tolist()], dtype=object).reshape(m.shape) for m in (a, x))
    full = a.astype(object) @ x.T.astype(object)
    return np.clip(full, _LOW, _HIGH)


class Chunk:
    """Anchors of one label in tree order, with the windows wanted of each: (anchor number, window number, low, high)."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, label: int, a: np.ndarray, parent: np.ndarray, edge: np.ndarray,
                 windows: list[list[tuple[int, int, int]]]):
        self.keys, self.ids, self.label, self.a, self.parent, self.edge, self.windows = keys, ids, label, a, parent, edge, windows
        depth = np.zeros(len(keys), dtype=np.int64)
        for i in range(1, len(keys)):
            depth[i] = depth[parent[i]] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]

    def scores(self, x: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, known) of every anchor and row; known where the bounds overlap the anchor's window from low to high."""
        if self.a.dtype == object or x.dtype == object:
            s = products(self.a, x)
            return s, np.ones(s.shape, dtype=bool)
        s = products(self.a[:1], x)
        if s.dtype == object:
            s = products(self.a, x)
            return s, np.ones(s.shape, dtype=bool)
        s = np.resize(s, (len(self.a), len(x)))
        far = np.zeros(s.shape)  # how far the score may lie from s, in norms of the row
        known = np.zeros(s.shape, dtype=bool)
        known[0] = True
        for level in self.levels[1:]:
            up = self.parent[level]
            centre, reach = s[up], far[up] + self.edge[level][:, None]
            bound = reach * norm * (1 + SLACK) + 1e-6
            open_ = (centre + bound >= low[level][:, None]) & (centre - bound <= high[level][:, None])
            known[level] = open_
            many = open_.mean(axis=1) > DENSE
            full, sparse = np.flatnonzero(many), np.flatnonzero(~many)
            if len(full):
                s[level[full]] = products(self.a[level[full]], x)
            for k in sparse:
                i, at = level[k], np.flatnonzero(open_[k])
                s[i], far[i] = centre[k], reach[k]
                s[i, at] = products(self.a[i:i + 1], x[at])[0]
                far[i, at] = 0.0
        return s, known


class Block:
    """Rows of a block in the order of labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, scale: int):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.x = ids[order], labels[order], quantised(x[order], scale)
        # Rows beyond the range of exact doubles are scored without bounds.
        self.norm = np.zeros(len(self.ids)) if self.x.dtype == object else np.sqrt((self.x * self.x).sum(axis=1))

    def ranges(self, label: int, same: bool) -> list[tuple[int, int]]:
        lo, hi = np.searchsorted(self.labels, label, "left"), np.searchsorted(self.labels, label, "right")
        return [(lo, hi)] if same else [(0, lo), (hi, len(self.ids))]

    def best(self, chunk: Chunk, same: bool, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(anchor number, window, vec_id, score): the k best rows of each window, those of equal score by smaller id.

        Slabs of rows come one after another; the k-th best so far closes a window from below for the next.
        """
        wanted = [(i, w, lo, hi) for i, ws in enumerate(chunk.windows) for w, lo, hi in ws]
        floors = [lo for _, _, lo, _ in wanted]
        held: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(wanted)
        for lo, hi in self.ranges(chunk.label, same):
            for at in range(lo, hi, SLAB):
                ids = self.ids[at:min(at + SLAB, hi)]
                low, high = np.full(len(chunk.keys), np.inf), np.full(len(chunk.keys), -np.inf)
                for j, (i, _, _, top) in enumerate(wanted):
                    low[i], high[i] = min(low[i], floors[j]), max(high[i], top)
                s, known = chunk.scores(self.x[at:at + len(ids)], self.norm[at:at + len(ids)], low, high)
                for j, (i, _, _, top) in enumerate(wanted):
                    hit = np.flatnonzero(known[i] & (s[i] >= floors[j]) & (s[i] <= top) & (ids != chunk.ids[i]))
                    if not len(hit):
                        continue
                    score, own = s[i][hit], ids[hit]
                    if held[j] is not None:
                        score, own = np.concatenate([held[j][0], score]), np.concatenate([held[j][1], own])
                    if len(score) > k:
                        cut = np.sort(score)[len(score) - k]
                        near = np.flatnonzero(score >= cut)
                        near = near[np.lexsort((own[near], -score[near]))][:k]
                        score, own = score[near], own[near]
                    held[j] = score, own
                    if len(score) == k:
                        floors[j] = max(floors[j], int(score.min()))
        for (i, w, _, _), found in zip(wanted, held):
            if found is not None:
                n = len(found[0])
                yield np.full(n, chunk.keys[i]), np.full(n, w), found[1], np.array([int(v) for v in found[0]], dtype=np.int64)


def _tree(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent by place in that order, edge length) of the minimum spanning tree, the middle-most anchor first."""
    n = len(a)
    square = (a * a).sum(axis=1)
    d = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * (a @ a.T), 0.0))
    root = int(d.sum(axis=1).argmin())
    order, parent, edge = [root], [0], [0.0]
    place = np.zeros(n, dtype=np.int64)
    best, by = d[root].copy(), np.full(n, root)
    best[root] = np.inf
    for _ in range(n - 1):
        i = int(best.argmin())
        place[i] = len(order)
        order.append(i)
        parent.append(int(place[by[i]]))
        gap = a[i] - a[by[i]]
        edge.append(float(np.sqrt((gap * gap).sum())))
        best[i] = np.inf
        nearer = (d[i] < best) & np.isfinite(best)
        best[nearer], by[nearer] = d[i][nearer], i
    return np.array(order), np.array(parent), np.array(edge)


def anchor_trees(anchors: DataFrame, scale: int) -> DataFrame:
    """(key, vec_id, label, v, chunk, place, parent, edge): anchors in chunks of one label, each in tree order; stored.

    Within a label anchors are ordered by the signs of the components that vary most, so that a chunk holds near ones.
    """
    dims = F.size(anchors["v"])
    spread = anchors.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s")).orderBy(
        F.desc("s"), "d").limit(SIGNS).collect()
    bits = [F.when(F.get("v", F.lit(r["d"])) > F.lit(r["m"]), "1").otherwise("0") for r in spread]
    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = anchors.filter(dims > 0).withColumn("near", F.concat(*bits) if bits else F.lit("")).repartitionByRange(parts, "label", "near", "key")
    ordered = ordered.sortWithinPartitions("label", "near", "key").select("key", "vec_id", "label", "v", F.spark_partition_id().cast("bigint").alias("part"))
    schema = pa.schema([("key", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.float64())), ("chunk", pa.int64()),
                        ("place", pa.int32()), ("parent", pa.int32()), ("edge", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            label = batch.column("label").to_numpy()
            at = 0
            while at < batch.num_rows:
                change = np.flatnonzero(label[at:at + CHUNK] != label[at])
                n = int(change[0]) if len(change) else min(CHUNK, batch.num_rows - at)
                piece = batch.slice(at, n)
                x = quantised(list_matrix(piece.column("v")), scale)
                with np.errstate(over="ignore", invalid="ignore"):
                    order, parent, edge = _tree(x) if x.dtype != object else (np.arange(n), np.zeros(n, dtype=int), np.zeros(n))
                taken = piece.take(pa.array(order))
                chunk = (int(piece.column("part")[0].as_py()) << 32) + number
                yield pa.RecordBatch.from_arrays(
                    [*(taken.column(c) for c in ("key", "vec_id", "label")), taken.column("v").cast(pa.list_(pa.float64())), pa.array(np.full(n, chunk)),
                     pa.array(np.arange(n, dtype=np.int32)), pa.array(parent.astype(np.int32)), pa.array(edge)], schema=schema)
                number, at = number + 1, at + n

    return stored(ordered.mapInArrow(run, "key bigint, vec_id bigint, label bigint, v array<double>, chunk bigint, place int, parent int, edge double"), "trees")


_WINDOWS = "array<struct<w:int,low:bigint,high:bigint>>"
_FOUND = "key bigint, w int, vec_id bigint, score bigint"


def _search(rows: DataFrame, trees: DataFrame, blocks: Column, same: bool, k: int, scale: int, parts: int) -> DataFrame:
    """(key, w, vec_id, score): from each block named in ``blocks`` the k best rows of each window of each anchor."""
    schema = pa.schema([("key", pa.int64()), ("w", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
    none = F.lit(None)
    left = rows.select("block", F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("chunk"), F.lit(0).alias("place"), "vec_id", "label", "v",
                       none.cast("bigint").alias("key"), none.cast("int").alias("parent"), none.cast("double").alias("edge"), none.cast(_WINDOWS).alias("windows"))
    right = trees.select(F.explode(blocks).alias("block"), F.lit(1).alias("side"), "chunk", "place", "vec_id", "label", "v", "key", "parent", "edge", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[pa.RecordBatch] = []
        block, at = None, None

        def chunk_of(t: pa.Table) -> Chunk:
            windows = [[(x["w"], x["low"], x["high"]) for x in ws] for ws in t.column("windows").to_pylist()]
            return Chunk(t.column("key").to_numpy(), t.column("vec_id").to_numpy(), t.column("label")[0].as_py(), quantised(list_matrix(t.column("v").combine_chunks()), scale),
                         t.column("parent").to_numpy(), t.column("edge").to_numpy(), windows)

        def finished() -> Iterator[pa.RecordBatch]:
            nonlocal block
            if not gathered:
                return
            t = pa.Table.from_batches(gathered)
            gathered.clear()
            if at[1] == 0:
                block = Block(t.column("vec_id").to_numpy(), t.column("label").to_numpy(), list_matrix(t.column("v").combine_chunks()), scale)
                block.number = at[0]
            elif block is not None and block.number == at[0]:
                found = list(block.best(chunk_of(t), same, k))
                if found:
                    yield batch_of(schema, *(np.concatenate(c) for c in zip(*found)))

        for batch in batches:
            numbers = [batch.column(c).to_numpy() for c in ("block", "side", "chunk")]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in numbers], axis=0)) + 1
            for s, e in zip([0, *edges], [*edges, batch.num_rows]):
                if s == e:
                    continue
                now = tuple(int(c[s]) for c in numbers)
                if now != at:
                    yield from finished()
                    at = now
                gathered.append(batch.slice(s, e - s))
        yield from finished()

    both = left.unionByName(right).repartition(parts, "block").sortWithinPartitions("block", "side", "chunk", "place")
    return both.mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key", "w").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(rows: DataFrame, n_blocks: int, trees: DataFrame, same: bool, k: int, scale: int) -> DataFrame:
    """(key, w, rank, vec_id, score): the k best rows of each window, of the anchor's own label or of the others; stored.

    ``rows`` (vec_id, label, v, block), ``trees`` as made by ``anchor_trees`` with a column windows (w, low, high).
    """
    shuffle = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = list(range(0, n_blocks, SEED_EVERY))
    seeds = F.sequence(F.lit(0), F.lit(n_blocks - 1), F.lit(SEED_EVERY))
    found = stored(_search(rows.filter(F.col("block") % SEED_EVERY == 0), trees, seeds, same, k, scale, max(1, min(len(first), shuffle))), "seeded")
    if n_blocks > 1:
        floors = _best(found, k).filter(F.col("rank") == k).select("key", F.struct("w", F.col("score").alias("floor")).alias("f")).groupBy("key").agg(
            F.map_from_entries(F.collect_list("f")).alias("floors"))
        raised = trees.join(floors, "key", "left").withColumn("windows", F.transform("windows", lambda x: F.struct(
            x["w"].alias("w"), F.greatest(x["low"], F.try_element_at(F.col("floors"), x["w"])).alias("low"), x["high"].alias("high")))).drop("floors")
        others = F.filter(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda b: b % SEED_EVERY != 0)
        found = found.unionByName(_search(rows.filter(F.col("block") % SEED_EVERY != 0), raised, others, same, k, scale, max(n_blocks, shuffle)))
    return stored(_best(found, k), "best")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and each of its positives.

    Scores are inner products of floor(scale * component). ``is_anchor`` (over vec_id) picks the anchors. An anchor's
    positives are the ``positives`` best rows of its label; a positive's negatives the ``negatives`` best rows of other
    labels whose score is ``low`` to ``high`` percent of the positive's. Equal scores go by smaller id.

    Rows with a null id, label or vector, with null or non-finite components, with no components or of another dimension than most take no
    part. Rows that share an id are each candidates and each anchors, but never one another's; an anchor without
    positives or negatives gives no row. Scores outside the range of a bigint are held at its ends. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = stored(usable(vectors, id_col, vec_col, label_col).withColumn("number", F.monotonically_increasing_id()), "vectors")
    n_blocks = max(1, -(-rows.count() // block))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(n_blocks)).cast("int"))
    trees = anchor_trees(rows.filter(is_anchor).withColumnRenamed("number", "key"), scale)
    whole = F.array(F.struct(F.lit(0).alias("w"), F.lit(_LOW).cast("bigint").alias("low"), F.lit(_HIGH).cast("bigint").alias("high"))).cast(_WINDOWS)
    near = search(placed, n_blocks, trees.withColumn("windows", whole), True, positives, scale)
    # Whole percents of a bigint: decimals hold 100 times it.
    score = F.col("score").cast("decimal(20,0)")
    window = F.struct(F.col("rank").alias("w"), F.ceil(score * F.lit(low) / F.lit(100)).cast("bigint").alias("low"), F.floor(score * F.lit(high) / F.lit(100)).cast("bigint").alias("high"))
    windows = near.select("key", window.alias("x")).filter("x.low <= x.high").groupBy("key").agg(F.sort_array(F.collect_list("x")).cast(_WINDOWS).alias("windows"))
    sought = stored(trees.join(windows, "key", "left").withColumn("windows", F.coalesce("windows", F.array().cast(_WINDOWS))), "sought")
    far = search(placed, n_blocks, sought, False, negatives, scale)
    names = trees.select("key", F.col("vec_id").alias("anchor_id"))
    ps = near.select("key", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(ps, ["key", "w"]).join(names, "key")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
g AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM g JOIN p USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
