"""Groups as membership rows, with a group dimension so that empty groups survive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("treatment", "replicate", "well")


def dimension(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def label(column: str) -> Column:
    """Groups are named by treatment; wells and replicates by ``[index]``."""
    if column == "treatment":
        return F.col(column).cast("string")
    return F.format_string("[%s]", F.col(column).cast("string"))


def group_dimension(cells: DataFrame, by: Sequence[str], reject: Sequence[str] = ()) -> DataFrame:
    """Every combination of the dimension values, also those no cell has.

    Each distinct list is a small aggregate; the combinations come from
    exploding one list after the other.
    """
    lists = cells.agg(*[F.collect_set(c).alias(c) for c in by])
    out = lists
    for c in by:
        out = out.withColumn(c, F.explode(c))
    if reject and "treatment" in by:
        out = out.filter(~F.col("treatment").isin(list(reject)))
    return out.withColumn("group_name", F.concat_ws(",", *[label(c) for c in by]))


def group_counts(cells: DataFrame, by: Sequence[str], members: Column, reject: Sequence[str] = ()) -> DataFrame:
    """Members per group; empty groups have count 0."""
    counts = cells.filter(members).groupBy(*by).agg(F.count("*").alias("n_cells"))
    return group_dimension(cells, by, reject).join(counts, list(by), "left").select(
        *by, "group_name", F.coalesce("n_cells", F.lit(0)).cast("bigint").alias("n_cells"))


def with_group_name(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return cells.withColumn("group_name", F.concat_ws(",", *[label(c) for c in by]))


def nested_counts(cells: DataFrame, outer: str, inner: str, members: Column) -> DataFrame:
    """Outer groups holding an array of inner groups. Inner lists are dimension-sized."""
    flat = group_counts(cells, [outer, inner], members)
    return flat.groupBy(outer).agg(
        F.sort_array(F.collect_list(F.struct(F.col(inner).alias("inner_group"), "n_cells"))).alias("groups"),
        F.sum("n_cells").alias("n_outer"))


def flatten_groups(nested: DataFrame, outer: str) -> DataFrame:
    return nested.select(outer, "n_outer", F.explode("groups").alias("g")).select(
        outer, "n_outer", F.col("g.inner_group").alias("inner_group"), F.col("g.n_cells").alias("n_cells"))


def custom_groups(cells: DataFrame, groups: Sequence[tuple[str, Column | str]]) -> DataFrame:
    """Membership rows of user-defined, possibly overlapping groups.

    One pass: each row carries the array of names whose predicate it meets.
    """
    named = [
        F.when(F.expr(p) if isinstance(p, str) else p, F.lit(name)) for name, p in groups
    ]
    hits = F.filter(F.array(*named), lambda x: x.isNotNull())
    return cells.withColumn("group_name", F.explode(hits))


def joined_members(membership: DataFrame, on: str = "object_id") -> DataFrame:
    return membership.select(on).distinct()


def control_groups(cells: DataFrame, controls: Sequence[str], members: Column) -> DataFrame:
    """Non-empty control treatment × replicate groups named ``treatment_replicate``."""
    return (
        cells.filter(F.col("treatment").isin(list(controls)) & members)
        .groupBy("treatment", "replicate").agg(F.count("*").alias("n_cells"))
        .withColumn("group_name", F.concat_ws("_", "treatment", "replicate"))
    )


def hierarchy_subtotals(cells: DataFrame, by: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Counts on every level of treatment → replicate → well in one pass; '*' marks a subtotal."""
    rolled = cells.rollup(*by).agg(
        F.count("*").alias("n_cells"),
        *[F.grouping(c).alias(f"_g_{c}") for c in by])
    names = [F.when(F.col(f"_g_{c}") == 1, F.lit("*")).otherwise(F.col(c).cast("string")).alias(c) for c in by]
    return rolled.select(*names, "n_cells")
