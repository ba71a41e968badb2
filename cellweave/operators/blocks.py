"""Work on all pairs of two row sets through equi-joins on block pairs.

Rows are hashed into blocks; every (left block, right block) cell is one join
key, so the pair work is spread evenly however the rows are keyed. Group maps
emit their pairs because the map is the result. Point-level operators never
emit pairs: a batch kernel reduces each block pair to one row per point.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
#: Blocks a side has before they grow, to this many times their rows; every block is copied once per block of the other side.
FEW_BLOCKS, GROWTH = 16, 8


def side_blocks(spark) -> int:
    """Blocks per side so that block pairs roughly fill the shuffle partitions."""
    return max(1, math.ceil(math.sqrt(int(spark.conf.get("spark.sql.shuffle.partitions")))))


def pair_rows(left: DataFrame, right: DataFrame, left_id: str, right_id: str,
              on: Sequence[str] = (), condition: Column | None = None) -> DataFrame:
    """All row pairs of two group-level tables (columns must have distinct names)."""
    n = side_blocks(left.sparkSession)
    every = F.sequence(F.lit(0), F.lit(n - 1))
    lhs = left.withColumn("_lb", F.pmod(F.xxhash64(left_id), F.lit(n)).cast("int")).withColumn(
        "_rb", F.explode(every))
    rhs = right.withColumn("_rb", F.pmod(F.xxhash64(right_id), F.lit(n)).cast("int")).withColumn(
        "_lb", F.explode(every))
    pairs = lhs.join(rhs, ["_lb", "_rb", *on]).drop("_lb", "_rb")
    return pairs if condition is None else pairs.filter(condition)


def make_blocks(df: DataFrame, id_col: str, vec_col: str, label_col: str | None = None,
                block_rows: int = BLOCK_ROWS, rows: int | None = None) -> DataFrame:
    """Pack points into blocks of about ``block_rows`` rows: (block, ids, labels, vecs)."""
    n = rows if rows is not None else df.count()
    blocks = max(1, math.ceil(n / block_rows))
    label = F.col(label_col) if label_col else F.lit(0)
    row = F.struct(F.col(id_col).alias("id"), label.alias("label"), F.col(vec_col).alias("vec"))
    packed = (
        df.select(F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"), row.alias("r"))
        .groupBy("block").agg(F.collect_list("r").alias("rs"))
    )
    return packed.select("block", F.col("rs.id").alias("ids"), F.col("rs.label").alias("labels"),
                         F.col("rs.vec").alias("vecs"))


def block_pairs(blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Each block next to each block: block count squared rows, a few blocks per task at a time."""
    left = blocks.select(
        F.col("block").alias("lb"), F.col("ids").alias("lids"), F.col("labels").alias("llabels"),
        F.col("vecs").alias("lvecs"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("rb"))
    right = blocks.select(
        F.col("block").alias("rb"), F.col("ids").alias("rids"), F.col("labels").alias("rlabels"),
        F.col("vecs").alias("rvecs"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("lb"))
    # one block pair is a unit of work: spread them over all tasks
    return left.join(right, ["lb", "rb"])


def blocked_reduce(points: DataFrame, id_col: str, vec_col: str, label_col: str | None,
                   kernel: Callable[..., pd.DataFrame], schema: str,
                   block_rows: int = BLOCK_ROWS, rows: int | None = None) -> DataFrame:
    """Run ``kernel(lids, llabels, L, rids, rlabels, R)`` on every block pair.

    The kernel reduces over the right block and returns at most a few rows per
    left point; the caller combines them with an ordinary ``groupBy(id)``. Blocks
    of many points grow, so that fewer copies are shuffled; the kernel then gets
    the left block in slices, so that it meets no more pairs at once.
    """
    rows = points.count() if rows is None else rows
    size = max(block_rows, min(math.ceil(rows / FEW_BLOCKS), GROWTH * block_rows))
    n = max(1, math.ceil(rows / size))
    pairs = block_pairs(make_blocks(points, id_col, vec_col, label_col, size, rows), n)
    step = max(1, block_rows * block_rows // size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                lids, llabels, left = np.asarray(r.lids), np.asarray(r.llabels), np.stack(r.lvecs)
                right = np.asarray(r.rids), np.asarray(r.rlabels), np.stack(r.rvecs)
                for i in range(0, len(lids), step):
                    yield kernel(lids[i:i + step], llabels[i:i + step], left[i:i + step], *right)

    return pairs.select("lids", "llabels", "lvecs", "rids", "rlabels", "rvecs").mapInPandas(run, schema)
