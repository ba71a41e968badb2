"""Exact deduplication with a two-pass Bloom filter.

Pass one reads every text once, stores (id, 64-bit hash, SHA-256) and sets the bits of each hash in a filter of fixed
size with two planes: bits set at least once and bits set at least twice. A hash whose bits are all in the second plane
may be repeated; any other hash is certainly unique. Pass two sends only the rows of possibly repeated hashes through a
shuffle; the rest pass straight through as their own group. False positives of the filter only cost shuffle.

The filter has ``BITS`` bits whatever the input is, so it may be broadcast; beyond some hundred million rows it fills up
and more rows shuffle, never fewer than needed. Texts themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import batch_of, id_and_text, space_runs
from cellweave.session import stored

#: Size of each plane of the filter and bits per hash. 2**26 bits are 8 MiB.
BITS = 1 << 26
HASHES = 2
#: The filter is merged in slices of so many bits.
SLICE_BITS = 1 << 19

_SLICE = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _positions(h: np.ndarray) -> np.ndarray:
    """Bit numbers of each hash, one row per hash function; the two are made distinct."""
    h = h.astype(np.uint64)
    a = (h & np.uint64(BITS - 1)).astype(np.int64)
    b = ((h >> np.uint64(32)) & np.uint64(BITS - 1)).astype(np.int64)
    return np.stack([a, np.where(a == b, (b + 1) % BITS, b)])


def _planes(batches):
    """Both planes over the hashes of one task, as the slices that have any bit; two planes of BITS bits in memory."""
    once, twice = np.zeros(BITS // 8, dtype=np.uint8), np.zeros(BITS // 8, dtype=np.uint8)
    for batch in batches:
        at, n = np.unique(_positions(batch.column(0).to_numpy(zero_copy_only=False)), return_counts=True)
        byte, mask = at >> 3, (np.uint8(128) >> (at & 7).astype(np.uint8))
        again = (n > 1) | ((once[byte] & mask) > 0)
        np.bitwise_or.at(twice, byte[again], mask[again])
        np.bitwise_or.at(once, byte, mask)
    size = SLICE_BITS // 8
    for s in np.flatnonzero(once.reshape(-1, size).any(axis=1)):
        yield batch_of(_SLICE, [int(s)], [once[s * size:(s + 1) * size].tobytes()], [twice[s * size:(s + 1) * size].tobytes()])


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The planes of one slice over all tasks: a bit that two tasks set once is set twice."""
    once = np.zeros(SLICE_BITS // 8, dtype=np.uint8)
    twice = np.zeros(SLICE_BITS // 8, dtype=np.uint8)
    for batch in batches:
        for o, t in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist()):
            o, t = np.frombuffer(o, dtype=np.uint8), np.frombuffer(t, dtype=np.uint8)
            twice |= t | (once & o)
            once |= o
    yield batch_of(_SLICE, [key[0].as_py()], [once.tobytes()], [twice.tobytes()])


def repeated_filter(hashes: DataFrame) -> np.ndarray:
    """Second plane of the filter over a one-column frame of 64-bit hashes: BITS / 8 bytes, a fixed size.

    The scan is coalesced to two tasks per core, so the planes that are merged do not grow with the number of splits.
    """
    tasks = max(2 * hashes.sparkSession.sparkContext.defaultParallelism, 2)
    slices = hashes.coalesce(tasks).mapInArrow(_planes, "slice int, once binary, twice binary")
    merged = slices.groupBy("slice").applyInArrow(_merge, "slice int, once binary, twice binary")
    plane = np.zeros(BITS // 8, dtype=np.uint8)
    for row in merged.select("slice", "twice").collect():
        at = row["slice"] * (SLICE_BITS // 8)
        plane[at:at + SLICE_BITS // 8] = np.frombuffer(row["twice"], dtype=np.uint8)
    return plane


def _keyed(docs: DataFrame) -> DataFrame:
    sha = F.sha2(F.encode(space_runs(F.coalesce(F.col("text"), F.lit(""))), "UTF-8"), 256)
    return docs.withColumn("_sha", sha).withColumn("_h", F.conv(F.substring("_sha", 1, 15), 16, 10).cast("bigint"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _sha: SHA-256 of the text with white-space runs as one space, _h: its 64-bit hash), stored; one scan of texts."""
    return stored(_keyed(id_and_text(docs, id_col, text_col)).select("doc_id", "_sha", "_h"), "fingerprints")


def _probe(rows: DataFrame):
    """Column function that tells whether a hash may be repeated in ``rows``."""
    plane = rows.sparkSession.sparkContext.broadcast(repeated_filter(rows.select("_h")))

    @F.pandas_udf("boolean")
    def maybe_repeated(h: pd.Series) -> pd.Series:
        at = _positions(h.to_numpy())
        bits = (plane.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        return pd.Series(bits.all(axis=0))

    return maybe_repeated


def _groups(maybe: DataFrame) -> DataFrame:
    return stored(maybe.groupBy("_sha").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when identical after each run of ASCII white space is one space; null counts as empty, so nulls and
    empty texts are one group, while a text of white space only is a single space and another group. The smallest id
    stays; rows that share both id and text are all marked kept but count one by one in ``group_size``. Rows with a null
    id take part in group sizes; a group of nothing but null ids has a null keep_id and keeps its rows. Other columns
    are ignored, whatever they are called. An empty table gives an empty result.
    """
    rows = fingerprints(docs, id_col, text_col)
    flagged = rows.withColumn("_again", _probe(rows)("_h"))
    single = flagged.filter("not _again").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"),
        F.col("_sha").alias("text_sha256"))
    maybe = flagged.filter("_again").select("doc_id", "_sha")
    grouped = maybe.join(_groups(maybe), "_sha").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))
    return single.unionByName(grouped)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept: a row of the smallest id.

    Rows whose hash is certainly unique are never shuffled. Of repeated rows that share id and text one stays; a group
    of nothing but null ids also leaves one row.
    """
    rows = fingerprints(docs)
    maybe_repeated = _probe(rows)
    keep = _groups(rows.filter(maybe_repeated("_h"))).select(F.col("_sha").alias("_g"), F.col("keep_id").alias("_k"))
    keyed = _keyed(docs.select(F.struct("*").alias("row"), "doc_id", "text")).drop("text").withColumn("_again", maybe_repeated("_h"))
    same = (F.col("_sha") == F.col("_g")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("_k"))
    first = keyed.filter("_again").join(keep, same, "left_semi").dropDuplicates(["_sha"])
    return keyed.filter("not _again").unionByName(first).select("row.*")


ORACLE = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
