from __future__ import annotations

import pytest

import __spark_entry__ as registered
from checks.compare import connect, differences
from voxspark.operators import meshes
from voxspark.operators.constraints import require_valid, validate_voxels
from voxspark.operators.manifest import manifest_entries
from voxspark.streaming.progress import latest_progress

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_agrees_with_its_sql(spark, connection, name):
    assert differences(spark, connection, registered.queries()[name], registered.oracle_sql()[name], SF) == []


def test_entry(spark):
    assert registered.entry(spark).columns == ["model_id", "axis", "quads", "positive"]


def box(spark, mesh, low, high):
    return spark.createDataFrame([(mesh, *low, *high)], "mesh_id string, " + ", ".join(f"{b} double" for b in meshes.BOUNDS))


def test_normalised_box(spark):
    corners = [("m", n, x, y, z) for n, (x, y, z) in enumerate([(1.0, -3.0, 1.0), (5.0, -1.0, 9.0), (3.0, -2.0, 5.0)])]
    vertices = spark.createDataFrame(corners, "mesh_id string, vertex_id long, x double, y double, z double")
    target = box(spark, "m", (9.0, 19.0, 29.0), (11.0, 21.0, 31.0))
    moved = meshes.mesh_bounds(meshes.normalize_to_bounds(vertices, target)).first()
    assert (moved.center_x, moved.center_y, moved.center_z) == (10, 20, 30)
    assert (moved.max_x - moved.min_x, moved.max_y - moved.min_y, moved.max_z - moved.min_z) == (1, 0.5, 2)
    point = vertices.where("vertex_id = 0")
    kept = meshes.normalize_to_bounds(point, target).first()
    assert not kept.normalized and (kept.x, kept.y, kept.z) == (1, -3, 1)
    other = box(spark, "m", (0.0, 0.0, 0.0), (1.0, 1.0, 1.0))
    empty = box(spark, "m", (1.0, 1.0, 1.0), (0.0, 0.0, 0.0))
    listed = vertices.select("mesh_id").distinct()
    assert meshes.target_bounds(listed, target, other).first().min_x == 9
    assert meshes.target_bounds(listed, empty, other).first().min_x == 0


def test_broken_voxels_are_named(spark):
    rows = [("m", 0, 0, 0, 0, None), ("m", 0, 0, 0, 9, None), ("m", -1, 0, 70000, None, 2)]
    voxels = spark.createDataFrame(rows, "model_id string, x int, y int, z int, ovoxel_type int, qef_rank int")
    models = spark.createDataFrame([("m", 4, 2)], "model_id string, resolution int, num_voxel long")
    found = {r.rule: r.violations for r in validate_voxels(voxels, models).collect()}
    assert found == {
        "voxel_count": 1,
        "ovoxel_type_range": 1,
        "qef_rank_range": 0,
        "duplicate_cell": 1,
        "key_range": 1,
        "record_range": 1,
        "resolution_limit": 0,
        "beyond_resolution": 1,
    }
    with pytest.raises(ValueError, match="duplicate_cell"):
        require_valid(validate_voxels(voxels, models))


def test_manifest_types(spark):
    text = '{"files":{"d/a.npy":{"kind":5,"labels":{"1":"one","2":2},"dynamic_labels":{"1":1},"isovalue":"x"},"b":7}}'
    frame = spark.createDataFrame([(1, text), (2, "no json"), (3, '{"files":[1]}')], "manifest_id int, text string")
    rows = {r.file: r for r in manifest_entries(frame).collect()}
    assert rows["a.npy"].kind is None and rows["a.npy"].labels == {"1": "one"}
    assert rows["a.npy"].dynamic_labels is None and rows["a.npy"].isovalue is None
    assert set(rows) == {"a.npy", "b"}


def test_progress_fields_keep_their_last_value(spark):
    lines = [
        (1, 1, 'PROGRESS {"stage":"read","fraction":0.5,"message":"a"}'),
        (1, 2, 'PROGRESS {"fraction":0.75}'),
        (1, 3, "PROGRESS {broken"),
        (1, 4, "progress {}"),
    ]
    frame = spark.createDataFrame(lines, "job int, line_no int, line string")
    assert tuple(latest_progress(frame).first()) == (1, "read", 0.75, "a")
