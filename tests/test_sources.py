"""CSV sets, datasets, models, exports, sweeps and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.config import SweepConfig
from cellweave.operators import profiles
from cellweave.operators.normalize import Scaling
from cellweave.plans import sweep
from cellweave.sources import csv_sets, dataset, exports


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_csv_sets(spark, tmp_path):
    write(tmp_path / "p1" / "a_Image.csv", "ImageNumber;FileName_D;PathName_D;Metadata_Well\n1;x.tif;img;7\n")
    write(tmp_path / "p1" / "a_Nuclei.csv", "Location;Name\n1.5;n1\n2.5;n2\n")
    write(tmp_path / "p1" / "a_Cells.csv", "Area;Cells_Shape\n10;0.5\n20;nan\n")
    write(tmp_path / "b_Image.csv", "ImageNumber;FileName_D;PathName_D;Metadata_Well\n2;y.tif;img;8\n")
    write(tmp_path / "b_Nuclei.csv", "Location;Name\n3.5;n3\n")
    write(tmp_path / "c_Image.csv", "ImageNumber;FileName_D;PathName_D;Metadata_Well\n3;z.tif;img;9\n")
    write(tmp_path / "c_Nuclei.csv", "Location;Name\n3.5;n3\n")
    write(tmp_path / "c_Cells.csv", "Area;Cells_Shape\n10;0.5\n20;1\n")
    t = csv_sets.import_csv(spark, str(tmp_path), "_Image", ["_Nuclei", "_Cells"], ";", id_columns=["Metadata_Well"])
    rows = t["objects"].orderBy("row_no").collect()
    assert [(r["Nuclei_Location"], r["Cells_Area"]) for r in rows] == [(1.5, 10.0), (2.5, 20.0)]
    assert "Nuclei_Name" not in t["objects"].columns and np.isnan(rows[1]["Cells_Shape"])
    image = [r for r in t["images"].collect() if r["ImageNumber"] == 1.0][0]
    assert image["Metadata_Well"] == "7" and image["image_files"][0]["path"] == "img/x.tif"
    assert [r["kind"] for r in t["incomplete"].collect()] == ["_Cells"]
    assert "row counts differ" in t["errors"].first()["error"]


def test_csv_import_scans_the_files_once(spark, tmp_path, monkeypatch):
    """One listing, one shuffle of contents; odd headers, short rows and quotes as csv.DictReader reads them."""
    for base, cells in (("a", 'Area,Area,Cells_Note\n1,2,"x,\ny"\n\n3,4\n'), ("b", None), ("c", "Area\n"), ("d", "Area\n5\n6\n")):
        write(tmp_path / f"{base}_Image.csv", "ImageNumber,Well\n" + "".join(f"{i},w\n" for i in range(2 if base == "a" else 1)))
        write(tmp_path / f"{base}_Nuclei.csv", "Location\n" + {"a": "7\n8\n", "b": "1\n", "c": "", "d": "9\n"}[base])
        if cells is not None:
            write(tmp_path / f"{base}_Cells.csv", cells)
    rows = csv_sets.read_sets(spark, str(tmp_path), "_Image", ["_Nuclei", "_Cells"])
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("binaryFile") == 1 and "Join" not in plan
    got = {(r["base"][-1], r["kind"], r["row_no"]): r for r in rows.collect()}
    assert set(got) == {("a", "object", 0), ("a", "object", 1), ("a", "error", -1), ("c", "empty", -1), ("d", "error", -1)}
    assert got["a", "object", 0]["values"] == {"Nuclei_Location": "7", "Cells_Area": "2", "Cells_Note": "x,\ny"}
    assert got["a", "object", 1]["values"] == {"Nuclei_Location": "8", "Cells_Area": "4", "Cells_Note": None}
    assert got["a", "object", 0]["image_values"] == {"ImageNumber": "0", "Well": "w"} and got["c", "empty", -1]["values"] == {}
    assert "row counts differ" in got["d", "error", -1]["error"] and "2 rows" in got["a", "error", -1]["error"]
    scans = []
    listed = csv_sets._files
    monkeypatch.setattr(csv_sets, "_files", lambda *a: scans.append(a) or listed(*a))
    tables = csv_sets.import_csv(spark, str(tmp_path), "_Image", ["_Nuclei", "_Cells"])
    assert len(scans) == 1 and tables["objects"].count() == 2 and tables["images"].count() == 2
    assert [(r["base"][-1], r["kind"]) for r in tables["incomplete"].collect()] == [("b", "_Cells")]


def test_dataset_and_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5)], "object_id bigint, treatment string, f1 double")
    dataset.save_dataset({"objects": df}, str(tmp_path / "d"), ["f1"])
    tables, features = dataset.load_dataset(spark, str(tmp_path / "d"))
    assert features == ["f1"] and tables["objects"].collect() == df.collect()
    dataset.save_dataset({"objects": df}, str(tmp_path / "e"), ["f1"], version="9.9")
    with pytest.raises(ValueError, match="unsupported"):
        dataset.load_dataset(spark, str(tmp_path / "e"))
    c = np.array([[1.0, np.nan], [0.1, 2.0]])
    dataset.save_model(spark, str(tmp_path / "m"), c, Scaling(("b", "a"), (1.0, 2.0), (0.5, 0.25)), {"k": 2})
    got, scaling, params = dataset.load_model(spark, str(tmp_path / "m"))
    np.testing.assert_array_equal(got, c)
    assert scaling.features == ("b", "a") and params == {"k": "2"}


def test_merge_rejects_missing_features(spark):
    a = spark.createDataFrame([("wt", "1", 3, 0.5)], "treatment string, replicate string, well int, f1 double")
    with pytest.raises(ValueError, match="lacks columns"):
        dataset.merge_datasets([a, a.drop("f1")], ["f1"])


def test_feature_header(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "object_id bigint, f1 double")
    exports.write_features(df, str(tmp_path / "f"), "object_id", ["f1"])
    assert spark.read.text(str(tmp_path / "f" / "rows")).first()[0] == "1\t0.500000"


def test_parameter_lists_and_grid(spark):
    items = spark.range(1).select(sweep.typed_items(F.lit("1, 2.5;abc  7")).alias("x")).first()["x"]
    assert [i["as_string"] for i in items] == ["1", "2.5", "abc", "7"]
    assert [i["as_int"] for i in items] == [1, None, None, 7]
    assert [i["as_float"] for i in items] == [1.0, 2.5, None, 7.0]
    grid = sweep.parameter_grid(spark, SweepConfig(methods=("k-means", "ward"), param1=(5, 10, 20)))
    assert grid.count() == 6
    assert sorted(sweep.grid_groups(grid, "param1").first()["param1_values"]) == [5.0, 10.0, 20.0]


def test_unknown_similarity_is_an_error(spark):
    heat = spark.createDataFrame([("a", "a", 0.0)], "row_group string, col_group string, distance double")
    with pytest.raises(ValueError):
        profiles.similarity_map(heat, "summed_difference")


@pytest.mark.parametrize("k", [5, 50])
def test_quadratic_chi_against_loops(spark, k):
    rng = np.random.default_rng(3)
    p = rng.uniform(size=(6, k))
    a = np.exp(-np.abs(rng.normal(size=(k, k))))
    a = (a + a.T) / 2
    prof = spark.createDataFrame([(f"g{i}", 1, [float(x) for x in r]) for i, r in enumerate(p)],
                                 "group_name string, n bigint, profile array<double>")
    got = {(r[0], r[1]): r[2] for r in profiles.distance_map(prof, "quadratic_chi", similarity=a, k=k).collect()}
    q = p / p.sum(1, keepdims=True)
    for i in range(6):
        for j in range(6):
            if i == j:
                want = 0.0
            else:
                d = (((q[i] + q[j])[:, None] * a) ** 0.5).sum(0)
                z = (q[i] - q[j]) / d
                want = z @ a @ z
            assert got[(f"g{i}", f"g{j}")] == pytest.approx(want, abs=1e-10)


def test_missing_names_lose_no_rows(spark):
    from cellweave.operators.validation import duplicate_at_random
    from cellweave.sources.dataset import merge_datasets

    rows = [(i, i * 31, [None, "a", "wt1"][i % 3], ["r", None, ""][i % 3], None, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "object_id bigint, seed_key bigint, treatment string, replicate string, well string, f double")
    merged, tables = merge_datasets([df, df], ["f"])
    assert merged.count() == 120 and tables["treatment"].count() == 3 and tables["well"].count() == 1
    assert merged.filter("treatment_index is null or well_index is null").count() == 0
    split = duplicate_at_random(df, "seed_key")
    counts = {r["treatment"]: r["count"] for r in split.groupBy("treatment").count().collect()}
    assert counts == {None: 20, "a": 10, "a*": 10, "wt1": 10, "wt1*": 10}
