"""Classifier-based comparisons of groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from cellweave.functions.scalars import in_fraction, portable_hash
from cellweave.operators import svm
from cellweave.operators.edf import numbered


#: Parts of a label that are ranked apart before their best rows are ranked together.
RANK_PARTS = 64


def training_rows(df: DataFrame, label: str, seed_key: str, per_group: int, seed: int = 0) -> DataFrame:
    """At most ``per_group`` rows of each label in hash order (the sample of the operator).

    A label is ranked in parts first, so at most RANK_PARTS times ``per_group`` of its rows meet.
    """
    order = [portable_hash(seed_key, seed), F.col(seed_key)]
    part = df.withColumn("_part", F.pmod(F.xxhash64(F.col(seed_key), F.lit(5)), F.lit(RANK_PARTS)))
    for keys in ([label, "_part"], [label]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        part = part.withColumn("_rank", rank).filter(F.col("_rank") <= per_group).drop("_rank")
    return part.drop("_part")


def _svc(max_iter: int = 15) -> LinearSVC:
    return LinearSVC(maxIter=max_iter, regParam=0.01, featuresCol="_v", labelCol="_y", predictionCol="prediction")


def pairwise_separability(df: DataFrame, label: str, vec: str, groups: Sequence, seed_key: str,
                          per_group: int = 1000) -> tuple[DataFrame, dict]:
    """Accuracy of a linear SVM for each pair of groups, trained on samples, scored on all their rows.

    All pairs are trained in shared passes and scored in one. Returns (row_group, col_group, accuracy) for i < j, and the
    weights (the last is the offset) of each pair.
    """
    names = list(groups)
    base = numbered(df.select(F.col(label).alias("_g"), F.col(seed_key).alias("_k"), F.col(vec).alias("_v")), "_g", names, "_c").persist(
        StorageLevel.MEMORY_AND_DISK)
    first = base.select(F.size("_v")).first()
    p = first[0] if first else 0
    fitted = svm.fit_pairs(training_rows(base, "_c", "_k", per_group), "_c", "_v", p, len(names))
    hits = svm.count_hits(base, "_c", "_v", p, fitted)
    base.unpersist()
    rows = [(str(names[i]), str(names[j]), float(h / n) if n else float("nan")) for (i, j), (h, n) in zip(fitted.pairs.tolist(), hits.tolist())]
    models = {(names[i], names[j]): w for (i, j), w in zip(fitted.pairs.tolist(), fitted.weights)}
    return df.sparkSession.createDataFrame(rows, "row_group string, col_group string, accuracy double"), models


def separability_map(pairs: DataFrame) -> DataFrame:
    """Symmetric map of max accuracy − 0.5 with a zero diagonal, ready for a linkage."""
    both = pairs.union(pairs.select(F.col("col_group").alias("row_group"), F.col("row_group").alias("col_group"), "accuracy"))
    off = both.groupBy("row_group", "col_group").agg((F.max("accuracy") - 0.5).alias("distance"))
    names = both.select("row_group").distinct()
    return off.union(names.select("row_group", F.col("row_group").alias("col_group"), F.lit(0.0).alias("distance")))


def confusion_matrix(df: DataFrame, labels: Sequence[str], vec: str, seed_key: str, fraction: float = 0.5,
                     seed: int = 1, max_iter: int = 15) -> DataFrame:
    """(label, prediction, n): one-vs-rest linear SVMs trained on a seeded part, counted on the rest."""
    named = df.withColumn("_label", F.concat_ws("_", *[F.col(c).cast("string") for c in labels]))
    names = [r[0] for r in named.select("_label").distinct().orderBy("_label").collect()]
    index = F.create_map(*[F.lit(x) for i, g in enumerate(names) for x in (g, float(i))])
    data = named.select(F.col(seed_key).alias("_k"), index[F.col("_label")].alias("_y"),
                        array_to_vector(vec).alias("_v")).persist(StorageLevel.MEMORY_AND_DISK)
    inside = in_fraction("_k", seed, fraction)
    model = OneVsRest(classifier=_svc(max_iter), featuresCol="_v", labelCol="_y", predictionCol="prediction",
                      parallelism=4).fit(
        data.filter(inside))
    counts = model.transform(data.filter(~inside)).groupBy("_y", "prediction").agg(F.count("*").alias("n"))
    back = F.create_map(*[F.lit(x) for i, g in enumerate(names) for x in (float(i), g)])
    out = counts.select(back[F.col("_y")].alias("label"), back[F.col("prediction")].alias("prediction"), "n")
    return out


def feature_ranking(weights: np.ndarray, features: Sequence[str], spark) -> DataFrame:
    """Squared SVM weights relative to the largest; the offset does not count."""
    w = np.asarray(weights, dtype=float)[:len(features)] ** 2
    return spark.createDataFrame([(f, float(x / w.max())) for f, x in zip(features, w)], "feature string, score double").orderBy(
        F.desc("score"), "feature")


def f_survival(f: float, d1: int, d2: int, steps: int = 4000) -> float:
    """P(F > f): the regularised incomplete beta function I_x(d2/2, d1/2) at x = d2/(d2 + d1·f).

    Midpoint rule after substituting t = x·e^(−u), in logs; one value per feature.
    """
    if not f > 0:
        return 1.0
    a, b = d2 / 2.0, d1 / 2.0
    x = d2 / (d2 + d1 * f)
    log_beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    top = 60.0 / a
    u = (np.arange(steps) + 0.5) * top / steps
    log_t = math.log(x) - u
    log_term = a * log_t + (b - 1.0) * np.log1p(-np.exp(log_t)) - log_beta
    return float(min(1.0, np.exp(log_term).sum() * top / steps))


def f_test_scores(df: DataFrame, label: str, vec: str, features: Sequence[str], max_p: float = 0.1) -> DataFrame:
    """Univariate F-test scores −log₁₀ p relative to the largest; features with p < ``max_p`` stay.

    Group counts, means and variances of all features come from one aggregate.
    """
    v, p = F.col(vec), len(features)
    rows = df.groupBy(label).agg(
        F.count("*").alias("n"), F.array(*[F.avg(v[i]) for i in range(p)]).alias("m"),
        F.array(*[F.var_pop(v[i]) for i in range(p)]).alias("s")).collect()
    n = np.array([r["n"] for r in rows], dtype=float)[:, None]
    mean, var = np.array([r["m"] for r in rows]), np.array([r["s"] for r in rows])
    grand = (n * mean).sum(axis=0) / n.sum()
    between = (n * (mean - grand) ** 2).sum(axis=0)
    within = (n * var).sum(axis=0)
    d1, d2 = len(rows) - 1, int(n.sum()) - len(rows)
    f = (between / d1) / (within / d2)
    prob = np.array([f_survival(x, d1, d2) for x in f])
    score = -np.log10(np.maximum(prob, 1e-300))
    top = score.max() if score.max() > 0 else 1.0
    out = [(a, float(b), float(c), float(s / top)) for a, b, c, s in zip(features, f, prob, score) if c < max_p]
    return df.sparkSession.createDataFrame(out, "feature string, f_value double, p_value double, score double")


def group_accuracy(confusion: DataFrame) -> DataFrame:
    """Share and number of correct predictions per label."""
    hit = F.col("label") == F.col("prediction")
    return confusion.groupBy("label").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_match"),
        (F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
