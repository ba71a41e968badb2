"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

A rotation is learned on a bounded sample (principal axes, then iterative quantisation), and a vector's code is the signs
of its rotated coordinates. The code is split into substrings, and every block of rows indexes each substring by its
value. By the pigeonhole principle a code within Hamming radius r of the query agrees with it in some substring up to
r / substrings bits, so probing all values within that small radius in every substring retrieves every code within r.
The codes found are then ranked by the exact cosine of the original vectors.

The radius is learned on the same sample: the Hamming distance within which nearly all true neighbours of sample queries
lie. Queries that find fewer than k rows within it are searched again with a radius that covers every code.

Queries and rows meet block by block: a task sees one block of queries and one block of indexed rows and returns at most
k rows for each query. No block depends on the value of a code, so copies of one vector spread evenly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import batch_of
from cellweave.session import stored

#: Rows the rotation and the radius are learned on at most, and queries among them.
SAMPLE_ROWS, SAMPLE_QUERIES = 8192, 512
#: Share of true neighbours that must lie within the learned radius.
WITHIN = 0.98
#: Code length and substrings; 16-bit substrings make an index of 65536 entries.
BITS, SUBSTRINGS = 64, 4
SUB_BITS = BITS // SUBSTRINGS
#: Rows in a block of the index and queries in a block.
INDEX_BLOCK, QUERY_BLOCK = 16_384, 4_096
ROTATIONS = 40


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v: array<double>) of the vectors that have a direction: not null, not zero, every component finite."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


class Codes:
    """The learned code: a rotation of unit vectors, their mean and the Hamming radius of neighbours."""

    def __init__(self, mean: np.ndarray, rotation: np.ndarray, radius: int):
        self.mean, self.rotation, self.radius = mean, rotation, radius

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """Substring values, shape (rows, SUBSTRINGS)."""
        bits = ((unit - self.mean) @ self.rotation > 0).astype(np.uint8)
        packed = np.packbits(bits, axis=1)
        return packed.view(">u2").astype(np.uint16).reshape(len(unit), SUBSTRINGS)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by the largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _POPCOUNT[a ^ b].sum(axis=-1, dtype=np.int32)


def learn(sample: np.ndarray, k: int, seed: int = 7) -> Codes:
    """Rotation and radius from sample vectors (rows); the rotation alternates with the signs it makes (ITQ)."""
    rng = np.random.default_rng(seed)
    unit = unit_rows(sample)
    mean = unit.mean(axis=0)
    centred = unit - mean
    dims = unit.shape[1]
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1]
    if dims >= BITS:
        basis = axes[:, :BITS]
    else:  # fewer dimensions than bits: further random directions
        basis = np.hstack([axes, rng.normal(size=(dims, BITS - dims)) / np.sqrt(dims)])
    projected = centred @ basis
    turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(ROTATIONS):
        u, _, vt = np.linalg.svd(np.sign(projected @ turn).T @ projected)
        turn = (u @ vt).T
    codes = Codes(mean, basis @ turn, BITS)
    n = len(unit)
    queries = rng.permutation(n)[:SAMPLE_QUERIES]
    own = codes(unit)
    distances = []
    for q in queries:
        cosine = unit @ unit[q]
        cosine[q] = -np.inf
        near = np.argsort(-cosine, kind="stable")[:min(k, n - 1)]
        distances.append(hamming(own[near], own[q]))
    seen = np.concatenate(distances) if distances else np.array([BITS])
    if len(seen):
        codes.radius = int(np.quantile(seen, WITHIN, method="higher"))
    return codes


def _masks(radius: int) -> np.ndarray:
    """All substring differences of at most so many bits."""
    if radius >= SUB_BITS:
        return np.arange(1 << SUB_BITS, dtype=np.uint16)
    out = [0]
    for r in range(1, radius + 1):
        out += [sum(1 << b for b in bits) for bits in combinations(range(SUB_BITS), r)]
    return np.array(out, dtype=np.uint16)


class BlockIndex:
    """Substring tables over the codes of one block."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(SUBSTRINGS)]
        self.first = [np.searchsorted(codes[o, s], np.arange((1 << SUB_BITS) + 1)) for s, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int, masks: np.ndarray) -> np.ndarray:
        """Rows whose code is within the radius: pigeonhole probing, then the whole distance."""
        if radius >= BITS:
            return np.arange(len(self.codes))
        hit = []
        for s in range(SUBSTRINGS):
            values = code[s] ^ masks
            lo, hi = self.first[s][values], self.first[s][values.astype(np.int64) + 1]
            n = hi - lo
            some = n > 0
            lo, n = lo[some], n[some]
            ends = np.cumsum(n)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - n), n)
            hit.append(self.order[s][at])
        rows = np.unique(np.concatenate(hit))
        return rows[hamming(self.codes[rows], code) <= radius]


def search(index_rows: DataFrame, queries: DataFrame, codes: Codes, k: int, radius: int) -> DataFrame:
    """(query_id, vec_id, score): for each query and index block the k nearest rows found, from which the caller ranks."""
    spark = index_rows.sparkSession
    blocks = max(1, -(-index_rows.count() // INDEX_BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def placed(df: DataFrame, n: int, other: int, name: str, other_name: str, side: int) -> DataFrame:
        own = F.pmod(F.xxhash64("vec_id", F.lit(side)), F.lit(n)).cast("int")
        return df.select("vec_id", "v", own.alias(name), F.lit(side).alias("side"), F.explode(
            F.sequence(F.lit(0), F.lit(other - 1))).alias(other_name))

    both = placed(index_rows, blocks, query_blocks, "ib", "qb", 0).unionByName(placed(queries, query_blocks, blocks, "qb", "ib", 1))
    shared = spark.sparkContext.broadcast(codes)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        t = pa.Table.from_batches(list(batches))  # one block of either side
        side = t.column("side").to_numpy()
        ids = t.column("vec_id").to_numpy()
        dims = own.rotation.shape[0]
        flat = t.column("v").combine_chunks()
        x = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        rows, qs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(rows) or not len(qs):
            return
        unit = unit_rows(x)
        code = own(unit)
        order = rows[np.argsort(ids[rows], kind="stable")]
        index, masks = BlockIndex(code[order]), _masks(radius // SUBSTRINGS)
        out: list[tuple[np.ndarray, ...]] = []
        for q in qs:
            found = order[index.within(code[q], radius, masks)]
            found = found[ids[found] != ids[q]]
            score = exact_cosine(x[found], x[q])
            best = np.lexsort((ids[found], -score))[:k]
            out.append((np.full(len(best), ids[q]), ids[found][best], score[best]))
        yield batch_of(schema, *(np.concatenate(c) for c in zip(*out)))

    return both.groupBy("ib", "qb").applyInArrow(run, "query_id bigint, vec_id bigint, score double")


def exact_cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine in double precision of each row with ``q``, added up in the order of the dimensions."""
    if not len(x):
        return np.empty(0)
    # Powers of two keep the squares in range without changing a digit.
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    q = np.ldexp(q, -np.frexp(np.abs(q).max())[1])
    dot, xx, qq = np.zeros(len(x)), np.zeros(len(x)), 0.0
    for d in range(x.shape[1]):
        dot += x[:, d] * q[d]
        xx += x[:, d] * x[:, d]
        qq += q[d] * q[d]
    return dot / (np.sqrt(xx) * np.sqrt(qq))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows by cosine of every row that ``is_query`` (over vec_id) picks.

    Vectors that are null, zero, hold null or non-finite components, have no id, or differ in dimension from the majority
    of the sample take no part, as query or candidate. Rows that share an id are each candidates; a query leaves out rows of its own
    id. Ties go to the smaller id. With fewer than k candidates all are returned. An empty table gives an empty result.
    """
    rows = stored(usable(vectors, id_col, vec_col), "vectors")
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # A hash of the id orders the sample, so it does not depend on the layout of the files.
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE_ROWS).collect()]
    if not sample:
        return empty
    dims = int(pd.Series([len(v) for v in sample]).mode().min())
    codes = learn(np.array([v for v in sample if len(v) == dims]), k)
    rows = rows.filter(F.size("v") == dims)
    queries = rows.filter(is_query)
    found = stored(search(rows, queries, codes, k, codes.radius), "found")
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    few = stored(queries.join(enough, queries["vec_id"] == enough["query_id"], "left_anti"), "few")
    if not few.isEmpty():
        wide = search(rows, few, codes, k, BITS)
        found = found.join(few.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(wide)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
