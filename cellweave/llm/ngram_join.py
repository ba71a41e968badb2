"""N-gram Jaccard join with Bayesian candidate pruning.

Documents become sets of word shingles; documents with the same set are one class and are joined through one of them.
A class has a number of its own, whatever ids its documents bear; its smallest id is looked up at the end.
Classes are compared by MinHash values. Classes that agree in a band of values meet as candidates; for each candidate
pair the values are compared in small steps, and with m agreements out of n the pair is dropped as soon as the posterior
probability of a similarity of at least the threshold (uniform prior) falls below ``TOLERANCE``. The pairs that stay
link classes into clusters; within a cluster every pair that survives the same pruning is verified exactly on the
shingle sets, and only verified links count.

No pair ever becomes a row: kernels see two blocks of a group, and return link counts per class and the edges of a
spanning forest, so a large group of near copies is split over many tasks and its output stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import batch_of, block_pairs, id_and_text, mix64, small_batches, texts_as_words, window_hashes
from cellweave.llm.components import components
from cellweave.session import forget, stored

SHINGLE, THRESHOLD = 5, 0.8
#: MinHash values in bands of ROWS: a pair at the threshold misses all bands with a chance of 3 in a million.
BANDS, ROWS = 24, 4
VALUES = BANDS * ROWS
#: Values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 8, 1e-6
#: Classes per block in the two kernels.
BAND_BLOCK, CLUSTER_BLOCK = 1024, 256

_MULTIPLIERS = mix64(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: runs of ``size`` words; a shorter text that has words is one shingle."""
    words, at = texts_as_words(column)
    out = []
    for i in range(len(at) - 1):
        w = words[at[i]:at[i + 1]]
        out.append(np.unique(window_hashes(w, min(size, len(w)))) if len(w) else np.empty(0, dtype=np.uint64))
    return out


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, shape (sets, VALUES), for sets that are not empty."""
    flat, first = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), VALUES), dtype=np.uint32)
    for v in range(VALUES):
        out[:, v] = np.minimum.reduceat((flat * _MULTIPLIERS[v]) >> np.uint64(32), first)
    return out


def drop_limits(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Fewest agreements after STEP, 2·STEP, ... values that keep a pair: below, P(similarity >= threshold) < tolerance."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            density = np.exp(log - log.max())
            if density[s >= threshold].sum() >= tolerance * density.sum():
                break
        out.append(m)
    return np.array(out)


def surviving_pairs(a: np.ndarray, b: np.ndarray, limits: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two signature blocks that no comparison step drops; i < j if both are one block."""
    found_i, found_j = [], []
    for i in range(len(a)):
        j = np.arange(i + 1 if same else 0, len(b))
        agree = np.zeros(len(j), dtype=np.int64)
        for step, limit in enumerate(limits):
            part = slice(step * STEP, (step + 1) * STEP)
            agree = agree + (b[j, part] == a[i, part]).sum(axis=1)
            keep = agree >= limit
            j, agree = j[keep], agree[keep]
            if not len(j):
                break
        found_i.append(np.full(len(j), i))
        found_j.append(j)
    return np.concatenate(found_i), np.concatenate(found_j)


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Edges that already connect all that the given ones connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(u.tolist(), v.tolist()):
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def _two_blocks(batches) -> tuple[pa.Table, np.ndarray, np.ndarray, bool]:
    t = pa.Table.from_batches(list(batches)).combine_chunks()
    b, lo, hi = (t.column(c).to_numpy() for c in ("_b", "_lo", "_hi"))
    same = lo[0] == hi[0]
    return t, np.flatnonzero(b == lo[0]), np.flatnonzero(b == hi[0]), bool(same)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, VALUES)


def _set_key(s: np.ndarray) -> bytes:
    """128 bits of a shingle set."""
    return np.array([mix64(s).sum(dtype=np.uint64), mix64(s * _MULTIPLIERS[0]).sum(dtype=np.uint64)], dtype="<u8").tobytes()


def _with_text_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tid, text): tid tells apart texts that share an id."""
    return id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("tid"), "text")


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tid, set_key, sig) per document, stored: a 128-bit key of its shingle set and its MinHash values; null without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2 << 20):
            sets = shingle_sets(batch.column("text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list[bytes | None] = [None] * len(sets)
            sigs: list[bytes | None] = [None] * len(sets)
            if full:
                for i, row in zip(full, signature([sets[i] for i in full])):
                    keys[i] = _set_key(sets[i])
                    sigs[i] = row.astype("<u4").tobytes()
            yield batch_of(schema, batch.column("doc_id"), batch.column("tid"), keys, sigs)

    return stored(_with_text_key(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, tid bigint, set_key binary, sig binary"), "signatures")


def candidate_clusters(reps: DataFrame) -> DataFrame:
    """(cls, cluster) of the classes that have a candidate which survives pruning; reps: (cls, sig), one row per class."""
    limits = drop_limits()
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 1 + 4 * ROWS * b, 4 * ROWS)) for b in range(BANDS)])
    members = stored(reps.select("cls", F.explode(bands).alias("band")), "bands")
    # Near copies share most of their bands: of bands with the same members (128 bits of a hash of the set) one is enough.
    buckets = members.groupBy("band").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y")).filter("n > 1")
    chosen = stored(buckets.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band"), "buckets")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, left, right, same = _two_blocks(batches)
        if not len(left) or not len(right):
            return
        cls, sig = t.column("cls").to_numpy(), _signatures(t.column("sig"))
        i, j = surviving_pairs(sig[left], sig[right], limits, same)
        edges = _forest(cls[left][i], cls[right][j])
        if edges:
            yield batch_of(schema, *zip(*edges))

    narrow = stored(members.join(chosen.hint("merge"), "band", "left_semi"), "bucket-members")
    forget(members)
    pairs = block_pairs(narrow, "band", "cls", BAND_BLOCK).join(reps.hint("merge"), "cls")
    edges = pairs.groupBy("band", "_lo", "_hi").applyInArrow(run, "u bigint, v bigint")
    return components(edges).withColumnsRenamed({"id": "cls", "component": "cluster"})


def verified_links(docs: DataFrame, reps: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """Rows (u, v, n) of verified links between classes: spanning edges (u, v) with n = 0, and link counts (u, null, n)."""
    limits = drop_limits(threshold)
    members = stored(reps.join(clusters, "cls").select("cls", "cluster", "set_key", "copies", "sig", "first.*"), "members")
    schema = pa.schema([("cls", pa.int64()), ("cluster", pa.int64()), ("copies", pa.int64()), ("sig", pa.binary()), ("shingles", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2 << 20):
            found = shingle_sets(batch.column("text"))
            own = [i for i, k in enumerate(batch.column("set_key").to_pylist()) if _set_key(found[i]) == k]
            yield batch_of(schema, *(batch.column(c).take(own) for c in ("cls", "cluster", "copies", "sig")),
                           [found[i].astype("<u8").tobytes() for i in own])

    # A class is read from the text of its first document; rows that repeat both id and text come several times, and one is used.
    texts = _with_text_key(docs).join(members.hint("merge"), ["doc_id", "tid"]).select("text", "cls", "cluster", "set_key", "copies", "sig")
    withsets = stored(texts.mapInArrow(sets, "cls bigint, cluster bigint, copies bigint, sig binary, shingles binary").withColumn(
        "row", F.monotonically_increasing_id()), "cluster-sets")
    one = withsets.groupBy("cls", "cluster").agg(F.min("row").alias("row"))
    out = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, left, right, same = _two_blocks(batches)
        if not len(left) or not len(right):
            return
        cls, copies, sig = t.column("cls").to_numpy(), t.column("copies").to_numpy(), _signatures(t.column("sig"))
        shingles = [np.frombuffer(x, dtype="<u8") for x in t.column("shingles").to_pylist()]
        i, j = surviving_pairs(sig[left], sig[right], limits, same)
        if not len(i):
            return
        i, j = left[i], right[j]
        n = np.array([len(s) for s in shingles])
        common = _overlaps(shingles, i, j)
        good = common >= threshold * (n[i] + n[j] - common) - 1e-9
        i, j = i[good], j[good]
        links = np.zeros(len(cls), dtype=np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        some = np.flatnonzero(links)
        rows = [(int(cls[x]), None, int(links[x])) for x in some] + [(u, v, 0) for u, v in _forest(cls[i], cls[j])]
        if rows:
            yield batch_of(out, *zip(*rows))

    pairs = block_pairs(one, "cluster", "row", CLUSTER_BLOCK).join(withsets.drop("cluster").hint("merge"), "row")
    return pairs.groupBy("cluster", "_lo", "_hi").applyInArrow(run, "u bigint, v bigint, n bigint")


def _overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common shingles of each pair, exactly: rows of the left set are marked once, then looked up for all its partners."""
    out = np.empty(len(i), dtype=np.int64)
    every, code = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    starts = ends - [len(s) for s in sets]
    mark = np.zeros(len(every), dtype=bool)
    order = np.argsort(i, kind="stable")
    bounds = np.flatnonzero(np.diff(i[order], prepend=-1))
    for k, lo in enumerate(bounds):
        rows = order[lo:bounds[k + 1] if k + 1 < len(bounds) else len(order)]
        x = i[rows[0]]
        own = code[starts[x]:ends[x]]
        mark[own] = True
        for r in rows:
            out[r] = mark[code[starts[j[r]]:ends[j[r]]]].sum()
        mark[own] = False
    return out


def _classified(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tid, rep_id, n_links, keeper) for every row: keeper is the smallest (doc_id, tid) it reaches over links, null without a set or id."""
    rows = classes_of(docs, id_col, text_col)
    with_set = rows.filter("set_key is not null and doc_id is not null")
    reps = stored(with_set.groupBy("set_key").agg(
        F.min(F.struct("doc_id", "tid")).alias("first"), F.count("*").alias("copies"), F.first("sig").alias("sig")).withColumn(
        "cls", F.monotonically_increasing_id()), "classes")
    clusters = stored(candidate_clusters(reps.select("cls", "sig")), "clusters")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = stored(verified_links(source, reps, clusters, threshold), "links")
    linked = stored(found.filter("v is null").groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("links")), "link-counts")
    reach = stored(components(found.filter("v is not null").select("u", "v")).withColumnRenamed("id", "cls").join(reps.select("cls", "first"), "cls"), "reach")
    keepers = reach.groupBy("component").agg(F.min("first").alias("keeper"))
    table = stored(reps.join(linked, "cls", "left").join(reach.select("cls", "component").join(keepers, "component"), "cls", "left").select(
        "set_key", F.col("first.doc_id").alias("rep_id"), F.coalesce("keeper", "first").alias("keeper"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "class-table")
    joined = with_set.select("doc_id", "tid", "set_key").join(table, "set_key").select("doc_id", "tid", "rep_id", "n_links", "keeper")
    alone = rows.filter("set_key is null or doc_id is null").select(
        "doc_id", "tid", F.col("doc_id").alias("rep_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast(table.schema["keeper"].dataType).alias("keeper"))
    return joined.unionByName(alone)


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, rep_id for every row: documents with a Jaccard similarity of at least ``threshold``.

    Words are runs of characters other than ASCII white space. ``n_links`` counts the other rows that are similar to the
    document; ``class_id`` is the smallest id it reaches over links (its own without any); ``rep_id`` is the smallest id
    with the same shingle set. A text without words (null, empty, white space) has no set, so no links. A text of fewer
    words than a shingle is one shingle. Rows with a null id take no part and come back with null ids and no links; rows
    that share an id are documents of their own, each with the links of its own text. Other columns are ignored.
    """
    return _classified(docs, threshold, id_col, text_col).select(
        "doc_id", F.coalesce("keeper.doc_id", "doc_id").alias("class_id"), "n_links", "rep_id")


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, one with its smallest id; all columns kept.

    Of texts that share that id one is kept, the one of the smallest hash. Rows with a null id and texts without words stay.
    Only ids and hashes travel to the filter, not texts.
    """
    ids = stored(_classified(docs, threshold, "doc_id", "text").filter("keeper is not null").select(
        F.col("doc_id").alias("_gone"), F.col("tid").alias("_gone_tid"), F.expr("doc_id = keeper.doc_id and tid = keeper.tid").alias("kept")), "near-copies")
    gone = ids.filter("not kept").select("_gone", "_gone_tid").distinct()
    again = stored(ids.filter("kept").groupBy("_gone", "_gone_tid").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated-rows")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tid"))
    same = lambda t: (F.col("_id") == t["_gone"]) & (F.col("_tid") == t["_gone_tid"])
    left = rows.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        left = left.join(again, same(again), "left_anti").unionByName(left.join(again, same(again), "left_semi").dropDuplicates(["_id", "_tid"]))
    return left.select("row.*")
