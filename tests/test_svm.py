"""Pairwise SVMs trained together: optimality, agreement with single fits, samples, accuracies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import classify, svm

RNG = np.random.default_rng(5)


def loss_and_gradient(x, y, w, ridge=svm.RIDGE):
    x = np.hstack([x, np.ones((len(x), 1))])
    short = np.maximum(0, 1 - y * (x @ w))
    free = np.append(np.full(x.shape[1] - 1, ridge), 0.0)
    return (short ** 2).mean() + 0.5 * (free * w * w).sum(), -2 * (x * (y * short)[:, None]).mean(axis=0) + free * w


@pytest.fixture(scope="module")
def rows(spark):
    centres = RNG.normal(size=(6, 5)) * 2
    code = np.concatenate([np.repeat(np.arange(6), 40), np.zeros(600, dtype=int)])  # group 0 holds most rows
    x = centres[code] + RNG.normal(size=(len(code), 5))
    df = spark.createDataFrame([(i, int(g), [float(v) for v in r]) for i, (g, r) in enumerate(zip(code, x))], "k bigint, g int, vec array<double>")
    return code, x, df.repartition(5).cache()


def test_all_pairs_are_at_their_optimum(rows):
    code, x, df = rows
    fitted = svm.fit_pairs(df, "g", "vec", 5, 6)
    assert len(fitted.pairs) == 15 and fitted.slope.max() < 1e-8 and fitted.rounds < 40
    hits = svm.count_hits(df, "g", "vec", 5, fitted)
    for (i, j), w, (hit, n) in zip(fitted.pairs, fitted.weights, hits):
        own = np.isin(code, (i, j))
        y = np.where(code[own] == j, 1.0, -1.0)
        low, slope = loss_and_gradient(x[own], y, w)
        assert np.abs(slope).max() < 1e-8
        for _ in range(20):  # convex: nothing near is lower
            assert loss_and_gradient(x[own], y, w + RNG.normal(size=6) * 0.05)[0] > low
        value = np.hstack([x[own], np.ones((own.sum(), 1))]) @ w
        assert n == own.sum() and hit == ((value > 0) == (y > 0)).sum()


def test_slices_give_the_same_models(rows, monkeypatch):
    _, _, df = rows
    whole = svm.fit_pairs(df, "g", "vec", 5, 6)
    monkeypatch.setattr(svm, "MAX_MODEL_VALUES", 4 * 2 * (2 + 6 + 36))
    parts = svm.fit_pairs(df, "g", "vec", 5, 6)
    assert (parts.pairs == whole.pairs).all() and np.allclose(parts.weights, whole.weights, atol=1e-7)


def test_samples_and_accuracies(spark, rows):
    code, _, df = rows
    sample = classify.training_rows(df, "g", "k", 30)
    counts = {r["g"]: r["count"] for r in sample.groupBy("g").count().collect()}
    assert counts == dict.fromkeys(range(6), 30)
    assert {r["k"] for r in sample.collect()} == {r["k"] for r in classify.training_rows(df.repartition(3), "g", "k", 30).collect()}
    pairs, models = classify.pairwise_separability(df.withColumn("s", F.col("g").cast("string")), "s", "vec", list("012345") + ["none"], "k")
    found = {(r["row_group"], r["col_group"]): r["accuracy"] for r in pairs.collect()}
    assert len(found) == 21 == len(models)
    assert all(a > 0.75 for (i, j), a in found.items() if j != "none")
    ranking = classify.feature_ranking(models["0", "1"], list("abcde"), spark).collect()
    assert ranking[0]["score"] == 1.0 and len(ranking) == 5


def test_pairs_without_rows_or_difference(spark):
    same = spark.createDataFrame([(i, i % 2, [1.0, 2.0]) for i in range(20)], "k bigint, g int, vec array<double>")
    fitted = svm.fit_pairs(same, "g", "vec", 2, 3)
    assert np.isfinite(fitted.weights).all() and (fitted.weights[1:, :] != np.inf).all()
    pairs, _ = classify.pairwise_separability(same.filter("g = 5").withColumn("s", F.lit("a")), "s", "vec", ["a", "b"], "k")
    assert np.isnan(pairs.first()["accuracy"])
