"""Feature importance of sub-populations from robust spreads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.scalars import ieee_divide
from cellweave.operators.order_stats import median_and_mad
from cellweave.operators.summaries import melt
from cellweave.session import cut_lineage


def feature_weighting(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Importance of every feature in every cluster: (cluster, feature, importance).

    1 − MAD_cluster/MAD_all where both are positive, scaled to [0, 1] within the
    cluster; −1 for the other features; all 1 for clusters below two points.
    """
    overall = median_and_mad(melt(df, features), ["feature"], "value").select(
        "feature", F.col("mad").alias("mad_all"))
    inside = median_and_mad(melt(df, features, [cluster]), [cluster, "feature"], "value").select(
        cluster, "feature", "n", "mad")
    both = cut_lineage(inside.join(overall, "feature"))
    usable = (F.col("mad") > 0) & (F.col("mad_all") > 0)
    raw = both.withColumn("_i", F.when(usable, 1 - F.col("mad") / F.when(usable, F.col("mad_all"))))
    # one row per feature in each window group
    w = Window.partitionBy(cluster)
    low = raw.withColumn("_i", F.col("_i") - F.min("_i").over(w))
    top = low.withColumn("_top", F.max("_i").over(w))
    scaled = F.when(F.col("_top") > 0, ieee_divide(F.col("_i"), F.col("_top"))).otherwise(F.col("_i"))
    value = (
        F.when(F.col("n") < 2, F.lit(1.0)).when(F.col("_i").isNull(), F.lit(-1.0)).otherwise(scaled))
    return top.select(cluster, "feature", value.alias("importance"))


def feature_importance(df: DataFrame, features: Sequence[str], member: str) -> DataFrame:
    """Importance of each feature for the rows where ``member`` (a SQL predicate) holds."""
    overall = median_and_mad(melt(df, features), ["feature"], "value").select(
        "feature", F.col("mad").alias("mad_all"))
    inside = median_and_mad(melt(df.filter(member), features), ["feature"], "value").select("feature", "n", "mad")
    both = cut_lineage(inside.join(overall, "feature").withColumn("_c", F.lit(0)))
    usable = (F.col("mad") > 0) & (F.col("mad_all") > 0)
    raw = both.withColumn("_i", F.when(usable, 1 - F.col("mad") / F.when(usable, F.col("mad_all"))))
    w = Window.partitionBy("_c")
    low = raw.withColumn("_i", F.col("_i") - F.min("_i").over(w)).withColumn("_top", F.max("_i").over(w))
    scaled = F.when(F.col("_top") > 0, ieee_divide(F.col("_i"), F.col("_top"))).otherwise(F.col("_i"))
    value = F.when(F.col("n") < 2, F.lit(1.0)).when(F.col("_i").isNull(), F.lit(-1.0)).otherwise(scaled)
    return low.select("feature", value.alias("importance"))
