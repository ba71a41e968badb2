"""Helpers the operators of this subpackage share: table access, Arrow batches, word arrays, group blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.tokenizing import free_other_stages
from cellweave.session import ship_package, stored

#: Rows of Python text held at once in a task; long texts come in smaller batches by bytes.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string): rows without an id keep a null id, a null text counts as empty."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def small_batches(batches, size: int = BATCH_BYTES):
    """Split Arrow batches so that each holds about ``size`` bytes of data (one row at least).

    Every operator over texts reads its batches here, so this is where a worker lets go of the coders of earlier stages.
    """
    free_other_stages()
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * size / max(batch.nbytes, 1)))
        for i in range(0, rows, step):
            yield batch.slice(i, step)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def space_runs(text: Column) -> Column:
    """Each run of space, tab, newline, vertical tab, form feed or carriage return as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


# --- words as numbers -------------------------------------------------------------------------------------------------

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_C = np.uint64(0xC2B2AE3D27D4EB4F | 1)
_C_INV = np.uint64(pow(int(_C), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word, a word being a maximal run of bytes other than ASCII white space."""
    solid = np.empty(len(raw) + 2, dtype=np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = ~_SPACE[raw]
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial over its bytes, read off prefix sums modulo 2**64."""
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_B, len(raw)), out=total[1:])
    return mix64((total[ends] - total[starts]) * powers(_B_INV, len(raw) + 1)[starts])


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; empty when there are fewer."""
    n = len(words)
    if n < size:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * powers(_C, n), out=total[1:])
    return mix64((total[size:] - total[:-size]) * powers(_C_INV, n - size + 1))


def texts_as_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts one after another, offsets by text) of an Arrow string column without nulls."""
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    else:
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    parts, counts = [], np.zeros(len(column) + 1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    for i in range(len(column)):
        raw = whole[offsets[i]:offsets[i + 1]]
        starts, ends = word_spans(raw)
        parts.append(word_hashes(raw, starts, ends))
        counts[i + 1] = len(starts)
    return (np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)), np.cumsum(counts)


# --- groups too large for one task ------------------------------------------------------------------------------------

def block_pairs(members: DataFrame, key: str, id_col: str, block: int) -> DataFrame:
    """Every pair of ids of a key meets in exactly one task group, and no task group holds more than about 2·``block`` ids.

    A key with n ids is split by a hash of the id into n / ``block`` blocks; each unordered pair of blocks is a group
    (``key``, _lo, _hi), and an id goes to the groups that name its block, with its own block in _b. Keys with one id
    disappear, since they have no pair. Only keys and ids move here; join what belongs to an id afterwards.
    """
    counts = stored(members.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1"), "group-sizes")
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    placed = members.select(key, id_col).join(counts.hint("merge"), key).select(
        key, id_col, blocks.alias("_k"), F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), blocks).cast("int").alias("_b"))
    return placed.select(key, id_col, "_b", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_o")).select(
        key, id_col, "_b", F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"))
