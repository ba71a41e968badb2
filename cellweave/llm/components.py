"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import forget, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour of a node to the smallest id around it: the larger neighbours, or the node and the smaller ones.

    The smallest id around a node is an aggregate that combines before the shuffle, so a node with many neighbours does
    not meet them in one task; joining it back is left to Spark's skew handling.
    """
    both = edges.select("u", "v").union(edges.select("v", "u")).toDF("u", "v")
    near = both.filter("v > u") if large else both.filter("v < u")
    smallest = stored((both if large else near).groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("c"), F.least("u", "m").alias("m")), "smallest")
    joined = near.join(smallest, near["u"] == smallest["c"])
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(smallest.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (u, v: bigint), component being the smallest id it reaches.

    Edges may repeat, run either way or join a node to itself; nodes that only have such loops, and null ends, do not
    appear. Each round is written to the shared folder and the one before deleted. When nothing changes any more, every
    node hangs on its component.
    """
    now = stored(edges.filter("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").cast("bigint").alias("u"), F.least("u", "v").cast("bigint").alias("v")).distinct(), "edges")
    last = None
    while True:
        step = stored(_star(now, large=True), "large-star")
        forget(now)
        now = stored(_star(step, large=False), "small-star")
        forget(step)
        # A fixed point of both steps has the same number and sum of edges; every step only ever lowers ends.
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        last = seen
