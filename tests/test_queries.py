"""Registered queries against their SQL on the smallest tables, and the driver contract."""

import pytest

import __spark_entry__ as entry
from cellweave.operators import quality
from oracle import compare, connection

QUICK = [
    "qc_cell_codes", "qc_image_codes", "qc_image_summary", "bad_feature_counts", "group_combinations", "custom_groups",
    "rank_within_group", "penetrance", "histogram", "covariance", "z_score_bad_values", "feature_selection",
    "edf_distance_matrix", "mahalanobis_group_map", "kmeans_lloyd", "kd_tree", "nearest_centroid", "min_ess_assignment",
    "soft_profiles", "smoothed_profiles", "distance_map_chi2_norm", "distance_map_quadratic_chi", "treatment_comparison",
    "duplicate_at_random", "csv_import", "dataset_merge", "model_scoring", "stream_quality", "stream_windows"]


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["treatment", "n_valid", "n_non_control", "penetrance"] and df.count() == 3


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_scan_is_pruned(spark, sf):
    plan = entry.queries()["qc_code_counts"](spark, sf)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double>" in plan


@pytest.mark.parametrize("name", ["quality_curve", "diagonal_by_clusters", "treatment_map"])
def test_quality_control_runs_once_for_all_maps(spark, sf, name, monkeypatch):
    """Each map and split used to run the quality control anew, several times over."""
    calls = []
    real = quality.run_quality_control
    monkeypatch.setattr(quality, "run_quality_control", lambda *a: calls.append(1) or real(*a))
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and "l_orderkey" not in plan
