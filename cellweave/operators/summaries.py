"""Populations, penetrance, histograms and table statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.scalars import above, ieee_divide
from cellweave.operators.order_stats import median_and_mad, running_totals


def _count(flag: Column) -> Column:
    return F.sum(flag.cast("bigint"))


def population(cells: DataFrame, by: Sequence[str] = ("treatment",)) -> DataFrame:
    """Valid and non-control valid cells per group."""
    return cells.groupBy(*by).agg(
        _count(F.col("is_valid")).alias("n_valid"),
        _count(F.col("is_valid") & F.col("is_non_control")).alias("n_non_control"))


def penetrance(cells: DataFrame, by: Sequence[str] = ("treatment",)) -> DataFrame:
    """Non-control share of the valid cells (NaN if there are none)."""
    pop = population(cells, by)
    return pop.withColumn(
        "penetrance", ieee_divide(F.col("n_non_control").cast("double"), F.col("n_valid").cast("double")))


def phenotype_treatments(cells: DataFrame, threshold: float = 0.2) -> DataFrame:
    return penetrance(cells).filter(above(F.col("penetrance"), F.lit(float(threshold))))


def penetrance_filter(cells: DataFrame, controls: Sequence[str]) -> DataFrame:
    """Cells of treatments whose penetrance exceeds that of all control treatments together."""
    pop = penetrance(cells)
    row = pop.filter(F.col("treatment").isin(list(controls))).agg(
        F.sum("n_non_control"), F.sum("n_valid")).first()
    limit = float("nan") if not row[1] else row[0] / row[1]
    keep = pop.filter(above(F.col("penetrance"), F.lit(limit))).select("treatment")
    return cells.join(keep, "treatment", "left_semi")


def distance_spread(cells: DataFrame, by: str = "treatment") -> DataFrame:
    """Median and MAD of the Mahalanobis distance per treatment, over valid and over non-control cells."""
    kinds = F.array(F.when(F.col("is_valid"), F.lit("valid")), F.when(F.col("is_non_control"), F.lit("non_control")))
    long = cells.select(by, "mahal_dist", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))
    return median_and_mad(long, [by, "kind"], "mahal_dist")


def cluster_population(assigned: DataFrame, k: int) -> DataFrame:
    """Members per cluster; empty clusters have count 0."""
    ids = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    counts = assigned.groupBy("cluster").agg(F.count("*").alias("n_cells"))
    return ids.join(counts, "cluster", "left").select(
        "cluster", F.coalesce("n_cells", F.lit(0)).cast("bigint").alias("n_cells"))


def cluster_treatment_distribution(assigned: DataFrame) -> DataFrame:
    """Per cluster and treatment: cells, and percent of that treatment's cells."""
    counts = assigned.groupBy("cluster", "treatment").agg(F.count("*").alias("n_cells"))
    totals = counts.groupBy("treatment").agg(F.sum("n_cells").alias("n_treatment"))
    return counts.join(totals, "treatment").select(
        "cluster", "treatment", "n_cells", (F.lit(100.0) * F.col("n_cells") / F.col("n_treatment")).alias("percent"))


def cluster_stddev(assigned: DataFrame, vec: str, p: int) -> DataFrame:
    """Centroid and population deviation vector per cluster, one pass."""
    v = F.col(vec)
    return assigned.groupBy("cluster").agg(
        F.count("*").alias("n"), F.array(*[F.avg(v[i]) for i in range(p)]).alias("centroid"),
        F.array(*[F.stddev_pop(v[i]) for i in range(p)]).alias("stddev"))


def projected_spread(stats: DataFrame) -> DataFrame:
    """|û·sdᵢ| + |û·sdⱼ| for every ordered pair of clusters, û the unit centroid difference.

    ``stats`` has one row per cluster (bounded by k), paired through block joins.
    """
    from cellweave.operators.blocks import pair_rows

    a = stats.select(F.col("cluster").alias("cluster_i"), F.col("centroid").alias("_ci"), F.col("stddev").alias("_si"))
    b = stats.select(F.col("cluster").alias("cluster_j"), F.col("centroid").alias("_cj"), F.col("stddev").alias("_sj"))
    pairs = pair_rows(a, b, "cluster_i", "cluster_j", condition=F.expr("cluster_i <> cluster_j"))
    diff = F.zip_with("_ci", "_cj", lambda x, y: x - y)
    norm = F.sqrt(F.aggregate(diff, F.lit(0.0), lambda acc, d: acc + d * d))

    def dot(sd: str) -> Column:
        return F.aggregate(F.zip_with(diff, sd, lambda d, s: d * s), F.lit(0.0), lambda acc, x: acc + x)

    spread = ieee_divide(F.abs(dot("_si")) + F.abs(dot("_sj")), norm)
    return pairs.select("cluster_i", "cluster_j", spread.alias("spread"))


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = (), lower: float | None = None,
              upper: float | None = None, drop_from: float | None = None, density: bool = False) -> DataFrame:
    """Equal-width bins, the last one closed. Range from the data unless given.

    With fixed edges, values outside are left out; ``drop_from`` removes large
    values first. Output: keys, bin, n (and density normalised per key).
    """
    src = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if drop_from is not None:
        src = src.filter(F.col(value) < F.lit(float(drop_from)))
    if lower is None or upper is None:
        row = src.agg(F.min(value), F.max(value)).first()
        lower, upper = float(row[0]), float(row[1])
        if lower == upper:
            lower, upper = lower - 0.5, upper + 0.5
    src = src.filter((F.col(value) >= F.lit(lower)) & (F.col(value) <= F.lit(upper)))
    width = (upper - lower) / bins
    index = F.least(F.floor((F.col(value) - F.lit(lower)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counts = src.groupBy(*keys, index.alias("bin")).agg(F.count("*").alias("n"))
    if not density:
        return counts
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    if keys:
        joined = counts.join(totals, list(keys))
    else:
        joined = counts.withColumn("_total", F.lit(totals.first()[0]))
    return joined.withColumn("density", F.col("n") / (F.col("_total") * F.lit(width))).drop("_total")


def categorical_histogram(df: DataFrame, column: str, rescale: float | None = None) -> DataFrame:
    """Rows per category, optionally rescaled so that the counts sum to ``rescale``."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    if rescale is None:
        return counts
    total = counts.agg(F.sum("n")).first()[0]
    return counts.withColumn("share", F.col("n") * F.lit(float(rescale)) / F.lit(float(total)))


def edf_steps(df: DataFrame, group: str, value: str) -> DataFrame:
    """Distinct values of each group with the fraction of its rows at or below them.

    Values are counted first and then accumulated over range partitions, so a
    group may be as large as the table.
    """
    counts = df.groupBy(group, value).agg(F.count("*").alias("_n"))
    run = running_totals(counts, [group], [value], {"_upto": F.col("_n")})
    totals = counts.groupBy(group).agg(F.sum("_n").alias("_total"))
    return run.join(totals, group).select(group, value, (F.col("_upto") / F.col("_total")).alias("edf"))


def ddim_histogram(df: DataFrame, group: str, vec: str, p: int, bins: int, first_group) -> DataFrame:
    """Sparse d-dimensional histogram density per group on the equal-width edges of the first group.

    Points outside those edges fall out of the histogram; the density divides by
    the points that remain and by the bin volume.
    """
    v = F.col(vec)
    edges = df.filter(F.col(group) == F.lit(first_group)).agg(
        *[f(v[i]) for i in range(p) for f in (F.min, F.max)]).first()
    inside, index, volume = F.lit(True), [], 1.0
    for i in range(p):
        lo, hi = float(edges[2 * i]), float(edges[2 * i + 1])
        width = (hi - lo) / bins
        volume *= width
        inside = inside & (v[i] >= F.lit(lo)) & (v[i] <= F.lit(hi))
        index.append(F.least(F.floor((v[i] - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1)))
    counts = df.filter(inside).groupBy(F.col(group).alias("group_name"), F.array(*index).alias("bins")).agg(
        F.count("*").alias("n"))
    totals = counts.groupBy("group_name").agg(F.sum("n").alias("_total"))
    return counts.join(totals, "group_name").select(
        "group_name", "bins", (F.col("n") / (F.col("_total") * F.lit(volume))).alias("density"))


def ddim_distances(hist: DataFrame) -> DataFrame:
    """Σ(h₁−h₂)² for every pair of groups, scaled by the smallest positive one.

    Σh₁² + Σh₂² − 2Σh₁h₂: only bins both groups fill are joined.
    """
    from cellweave.operators.blocks import pair_rows

    squares = hist.groupBy("group_name").agg(F.sum(F.col("density") * F.col("density")).alias("sq"))
    a = hist.select(F.col("group_name").alias("group_i"), "bins", F.col("density").alias("hi"))
    b = hist.select(F.col("group_name").alias("group_j"), "bins", F.col("density").alias("hj"))
    cross = a.join(b, "bins").groupBy("group_i", "group_j").agg(F.sum(F.col("hi") * F.col("hj")).alias("hh"))
    si = squares.select(F.col("group_name").alias("group_i"), F.col("sq").alias("si"))
    sj = squares.select(F.col("group_name").alias("group_j"), F.col("sq").alias("sj"))
    pairs = pair_rows(si, sj, "group_i", "group_j")
    raw = pairs.join(cross, ["group_i", "group_j"], "left").select(
        "group_i", "group_j",
        F.when(F.col("group_i") == F.col("group_j"), F.lit(0.0)).otherwise(
            F.col("si") + F.col("sj") - 2 * F.coalesce("hh", F.lit(0.0))).alias("distance"))
    smallest = raw.filter(F.col("distance") > 0).agg(F.min("distance")).first()[0]
    return raw.withColumn("scaled", F.col("distance") / F.lit(float(smallest) if smallest else 1.0))


def dataset_statistics(cells: DataFrame, images: DataFrame, upper: float | None, median: float | None,
                       mad: float | None) -> DataFrame:
    """One row: cells and images before and after quality control, cutoff and control spread."""
    im = images.agg(F.count("*"), _count(F.col("image_code") == 0)).first()
    return cells.agg(
        F.count("*").alias("n_cells"), _count(F.col("is_valid")).alias("n_valid_cells"),
        _count(F.col("is_non_control")).alias("n_non_control_cells"),
        F.lit(im[0]).cast("bigint").alias("n_images"), F.lit(im[1]).cast("bigint").alias("n_valid_images"),
        F.lit(upper).cast("double").alias("cutoff"), F.lit(median).cast("double").alias("control_median"),
        F.lit(mad).cast("double").alias("control_mad"))


def melt(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep…, feature, value); partial aggregates absorb the blow-up before any shuffle."""
    return df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        list(keep), list(features), "feature", "value")


def robust_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Median and MAD of every feature."""
    return median_and_mad(melt(df, features), ["feature"], "value")


def feature_box(df: DataFrame, features: Sequence[str]) -> DataFrame:
    row = df.agg(*[f(F.col(x).cast("double")) for x in features for f in (F.min, F.max)]).first()
    parts = [(x, row[2 * i], row[2 * i + 1]) for i, x in enumerate(features)]
    return df.sparkSession.createDataFrame(parts, "feature string, minimum double, maximum double")
