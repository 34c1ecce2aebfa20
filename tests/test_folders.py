from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.voxel_files import write_vxz
from voxspark.operators.ordinals import sorted_ordinals
from voxspark.plans.folders import folder_categories, folder_labels, load_folders
from voxspark.sources import npy
from voxspark.sources.files import resolve
from voxspark.sources.listing import list_tree
from voxspark.sources.npy import NpyHeader, Spans, decode_volumes, load_volumes, read_volumes
from voxspark.sources.vxz import corpus_files, decode


def roots(spark, *rows):
    return spark.createDataFrame(list(rows), "root string, path string")


def test_walk_lists_folders_files_links_and_what_cannot_be_listed(spark, tmp_path):
    top = tmp_path / "a tree#1 %20"
    for name in ("B/deep/x y.npy", "B/Z.txt", "b2/é.npy", "a.ply", "C.obj"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(b"12345")
    (top / "empty").mkdir()
    (top / "gone").symlink_to(top / "nowhere")
    (top / "B/up").symlink_to(top)
    (top / "linked").symlink_to(top / "b2")
    os.utime(top / "a.ply", (1_000, 1_000.5))
    listed = list_tree(roots(spark, ("r", f"file://{top}"), ("none", str(tmp_path / "missing")), ("plain", str(top / "b2")))).collect()
    found = [(r.root, r.dir, r.name, r.type, r.size) for r in sorted(listed, key=lambda r: (r.root, r.ordinal))]
    assert found == [
        ("none", "", "", "unreadable", None),
        ("plain", "", "é.npy", "file", 5),
        ("r", "", "B", "directory", None),
        ("r", "", "b2", "directory", None),
        ("r", "", "empty", "directory", None),
        ("r", "", "linked", "directory", None),
        ("r", "", "a.ply", "file", 5),
        ("r", "", "C.obj", "file", 5),
        ("r", "B", "deep", "directory", None),
        ("r", "B", "up", "directory", None),
        ("r", "B", "Z.txt", "file", 5),
        ("r", "B/deep", "x y.npy", "file", 5),
        ("r", "b2", "é.npy", "file", 5),
        ("r", "linked", "é.npy", "file", 5),
    ]
    by_name = {r.name: r for r in listed}
    assert by_name["a.ply"].mtime_ms == 1_000_500 and by_name["a.ply"].path == f"file://{top}/a.ply"
    assert "missing" in next(r.error for r in listed if r.type == "unreadable")
    assert {r.dir for r in list_tree(roots(spark, ("r", str(top))), max_depth=1).collect()} == {""}
    assert list_tree(roots(spark)).count() == 0


def test_paths_of_uris_are_taken_as_spark_writes_them():
    assert resolve("/a b/c%20d#e")[1] == "/a b/c%20d#e" == resolve("file:///a b/c%20d#e")[1] == resolve("file:/a b/c%20d#e")[1]
    assert resolve("relative/path:1.npy")[1] == "relative/path:1.npy"


def test_voxel_files_with_odd_names_are_decoded(spark, tmp_path):
    write_vxz(tmp_path / "a b#1%20.vxz", [(0, 0, 0)], [(1, 2, 3)], [0], chunk_size=2)
    files = corpus_files(spark, str(tmp_path))
    assert decode(files).where("error IS NULL").count() == 1


def test_ordinals_of_ties_nulls_and_one_large_group(spark):
    rows = [("big", n % 7) for n in range(3000)] + [(None, 1), (None, 1), ("x", None), ("x", 3)]
    frame = spark.createDataFrame(rows, "g string, v int").repartition(5)
    found = sorted_ordinals(frame, (F.col("v"),), "place", ["g"]).collect()
    for group in ("big", None, "x"):
        mine = sorted((r.place, -1 if r.v is None else r.v) for r in found if r.g == group)
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)
    assert sorted_ordinals(frame.limit(0), (F.col("v"),), "place", ["g"]).count() == 0


class Counted:
    """A file handle that counts what is read."""

    def __init__(self, data):
        self.data, self.at, self.bytes, self.reads = data, 0, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, length):
        self.bytes, self.reads = self.bytes + length, self.reads + 1
        return self.data[self.at : self.at + length]


@pytest.mark.parametrize("fortran", [False, True])
@pytest.mark.parametrize("axis", ["i", "j", "k"])
@pytest.mark.parametrize("parts", [1, 3])
def test_slabs_read_only_their_byte_runs(monkeypatch, fortran, axis, parts):
    monkeypatch.setattr(npy, "GAP_BYTES", 64)
    shape = (6, 9, 40)
    values = np.arange(np.prod(shape)).reshape(shape).astype("<i4")
    data = np.asfortranarray(values).tobytes("A") if fortran else values.tobytes()
    header = NpyHeader("<i4", fortran, shape, 0, "pipelineLabels")
    side = dict(zip("ijk", shape))[axis]
    handle, found = Counted(data), {}
    for part in range(parts):
        for _, i, j, k, value in npy._cells(handle, header, "v", {axis: (2, 3)}, part, parts):
            found.update(zip(zip(i.to_pylist(), j.to_pylist(), k.to_pylist(), strict=True), value.to_pylist(), strict=True))
    expected = {n: float(v) for n, v in np.ndenumerate(values) if n["ijk".index(axis)] == 2}
    assert found == expected
    sides = shape[::-1] if fortran else shape
    place = ("kji" if fortran else "ijk").index(axis)
    gaps = {0: 0, 1: (sides[1] - 1) * sides[2], 2: sides[2] - 1}
    if place == 0 or gaps[place] * 4 > 64:
        assert handle.bytes == values.nbytes // side
    else:
        assert handle.bytes < values.nbytes and handle.reads == parts  # short gaps are read along


def test_spans_of_boxes_beyond_the_array():
    assert len(Spans.of((4, 4, 4), ((0, 0), (0, 4), (0, 4)), 8)) == 0
    assert len(Spans.of((4, 4, 4), ((7, 9), (0, 4), (0, 4)), 8)) == 0
    assert list(Spans.of((4, 4, 4), ((-5, 99), (0, 4), (0, 4)), 0).pieces(0, 1)) == [(0, 64)]
    runs = [p for part in range(3) for p in Spans.of((4, 4, 4), ((1, 3), (1, 3), (0, 2)), 0).pieces(part, 3)]
    assert runs == [(20, 22), (24, 26), (36, 38), (40, 42)]


def test_listed_volumes_have_statuses_warnings_and_shares(spark, tmp_path):
    values = np.arange(60, dtype="<i8").reshape(3, 4, 5)
    wide = values.copy()
    wide[1, 1, 1] = -(1 << 60)
    for name, array in (("a/004_final_labels", values), ("b/004_final_labels", wide), ("c/004_final_labels", values[0]), ("d/other", values)):
        (tmp_path / name).parent.mkdir()
        np.save(tmp_path / f"{name}.npy", array)
    rows = [(n, str(tmp_path / f"{n}/{'other' if n == 'd' else '004_final_labels'}.npy")) for n in "abcde"] + [("twice", "x.npy"), ("twice", "y.npy")]
    files = spark.createDataFrame(rows, "volume_id string, path string")
    loaded = load_volumes(files, {"k": (1, 3)})
    status = {r.volume_id: (r.status, r.reason) for r in loaded.statuses.collect()}
    assert {v for v, (s, _) in status.items() if s == "loaded"} == {"a", "b"} and "dimensions" in status["c"][1] and "name" in status["d"][1]
    assert status["twice"] == ("failed", "duplicate volume_id") and loaded.statuses.count() == 7
    warned = {r.volume_id: r.warnings for r in loaded.volumes.collect()}
    assert warned["a"] is None and len(warned["b"]) == 1 and "64-bit" in warned["b"][0]
    assert {(r.i, r.j, r.k): r.value for r in loaded.cells.where("volume_id = 'a'").collect()} == {
        n: float(v) for n, v in np.ndenumerate(values) if 1 <= n[2] < 3
    }
    volumes = read_volumes(files)
    cells = decode_volumes(volumes, split_bytes=100).where("error IS NULL")
    assert cells.count() == 120 and cells.select("volume_id", "i", "j", "k").distinct().count() == 120
    with pytest.raises(ValueError, match="no axes"):
        decode_volumes(volumes, {"z": (0, 1)})
    assert load_volumes(files.limit(0)).cells.count() == 0


def test_filters_on_any_axis_prune_the_npy_scan(spark, tmp_path):
    values = np.arange(20 * 30 * 40, dtype="<u2").reshape(20, 30, 40)
    np.save(tmp_path / "004_final_labels.npy", values)
    cells = spark.read.format("npy").option("splitBytes", "9000").load(str(tmp_path))
    for condition, part in (("k = 7", values[:, :, 7]), ("j > 3 AND j <= 6", values[:, 4:7]), ("i >= 18 AND k < 2", values[18:, :, :2]), ("j = 99", values[:0])):
        assert sorted(r.value for r in cells.where(condition).collect()) == sorted(part.astype(float).ravel().tolist())


def test_a_folder_is_loaded_through_its_selection(spark, tmp_path):
    values = np.zeros((4, 4, 4), "<i4")
    values[0] = 3
    good = tmp_path / "p/good"
    good.mkdir(parents=True)
    for role in ("labels", "components", "cases"):
        np.save(good / f"005_final_ccl_{role}.npy", values)
    (good / "npy_labels.json").write_text(json.dumps({"files": {"005_final_ccl_cases.npy": {"labels": {"3": "three: deep", "x": 1}}}}))
    (good / "006_inside_filtered_labels.npy").write_bytes(b"junk")
    (tmp_path / "p/lost").mkdir()
    (tmp_path / "p/lost/004_final_labels.npy").write_bytes(b"never opened")
    (tmp_path / "q").mkdir()
    (tmp_path / "q/mesh.ply").write_bytes(b"")
    folders = load_folders(list_tree(roots(spark, ("p", str(tmp_path / "p")), ("q", str(tmp_path / "q")))))
    assert {(r.volume_id, r.status) for r in folders.volumes.statuses.collect()} == {
        *[(f"p/good/005_final_ccl_{role}.npy", "loaded") for role in ("labels", "components", "cases")],
        ("p/good/006_inside_filtered_labels.npy", "failed"),
    }
    texts = {(r.volume_id[-10:], int(r.label)): (r.cells, r.text) for r in folder_labels(folders).collect()}
    assert texts[("_cases.npy", 3)] == (16, "three: deep") and texts[("_cases.npy", 0)] == (48, "L-infinity case 0")
    assert sum(r.cells for r in folder_categories(folders).where("volume_id LIKE '%labels.npy'").collect()) == 64
    assert [(r.root, r.name) for r in folders.first.collect()] == [("p", "005_final_ccl_cases.npy")]
    assert [r.root for r in folders.left_out.collect()] == ["q"]
