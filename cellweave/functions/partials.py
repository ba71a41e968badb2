"""Per-partition partial sums of batch kernels, added up by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellweave.model import check_model_size

#: Partial matrices the driver adds up itself.
PARTS = 64


def list_matrix(column: pa.Array) -> np.ndarray:
    """Arrow list column → matrix without per-row objects."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def matrix_list(m: np.ndarray) -> pa.Array:
    n, width = m.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m, dtype=float).ravel()))


def partition_sums(df: DataFrame, vec: str, kernel: Callable[[np.ndarray], np.ndarray],
                   rows: int, width: int) -> np.ndarray:
    """Sum of ``kernel(X)`` (a rows × width array) over all batches of the table.

    Each partition sends its own total only, so the shuffle carries
    rows × width values per partition whatever the number of points is.
    """
    check_model_size(rows * width, "partial sums")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((rows, width))
        for batch in batches:
            if batch.num_rows:
                acc += kernel(list_matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(rows, dtype=np.int32)), matrix_list(acc)], names=["row", "part"])

    return _added_up(df.select(vec).mapInArrow(run, "row int, part array<double>"), rows, width, True)


def packed_blocks(df: DataFrame, vec: str, rows_per_block: int = 4096) -> DataFrame:
    """Points as matrices of doubles, one per row: (block binary). Persist it to read the points many times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows_per_block):
                x = np.ascontiguousarray(list_matrix(batch.column(0).slice(i, rows_per_block)), dtype=float)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()])], names=["block"])

    return df.select(vec).mapInArrow(run, "block binary")


def block_sums(blocks: DataFrame, features: int, kernel: Callable[[np.ndarray], np.ndarray], rows: int, width: int,
               many: bool = True) -> np.ndarray:
    """``partition_sums`` over packed blocks; ``many``: over more than PARTS partitions."""
    check_model_size(rows * width, "partial sums")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((rows, width))
        for batch in batches:
            for raw in batch.column(0):
                acc += kernel(np.frombuffer(raw.as_buffer(), dtype=float).reshape(-1, features))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), matrix_list(acc)], names=["row", "part"])

    return _added_up(blocks.mapInArrow(run, "row int, part array<double>"), rows, width, many)


def _added_up(partial: DataFrame, rows: int, width: int, many: bool) -> np.ndarray:
    """Sum of the partial matrices, of which at most PARTS come to the driver: tasks add up ``many`` first."""
    if many:

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((rows, width))
            for batch in batches:
                np.add.at(acc, batch.column(0).to_numpy(), list_matrix(batch.column(1)).reshape(-1, width))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), matrix_list(acc)], names=["row", "part"])

        partial = partial.repartition(PARTS).mapInArrow(add, "row int, part array<double>")
    out = np.zeros((rows, width))
    found = partial.toArrow()
    np.add.at(out, found.column("row").to_numpy(), list_matrix(found.column("part").combine_chunks()).reshape(-1, width))
    return out
