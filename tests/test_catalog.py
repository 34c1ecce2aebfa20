from __future__ import annotations

from voxspark.operators.catalog import classified_files

NAMES = [("000_original_boundary.npy", "volume"), ("005_final_ccl_labels.npy", "volume"), ("006_inside_filtered_labels.npy", "volume"), ("mesh.ply", "mesh")]


def test_names_are_matched_once_a_row_and_on_all_cores(spark):
    rows = [("r", "d", n, name, "file") for n, (name, _) in enumerate([*NAMES, ("npy_labels.json", "manifest"), ("notes.txt", None)])]
    files = spark.createDataFrame([*rows, ("r", "d", 9, "mesh.ply", "directory")], "root string, dir string, ordinal long, name string, type string").coalesce(1)
    classified = classified_files(files)
    assert {r["name"]: r["kind"] for r in classified.collect()} == dict([*NAMES, ("npy_labels.json", "manifest")])
    plan = classified._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") + plan.lower().count("rlike") < 20
    assert classified.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
