from __future__ import annotations

import io
import random

import numpy as np
import pytest

from voxspark.sources import mesh_files
from voxspark.sources.mesh_files import load_meshes, text_lines


def test_every_line_is_of_exactly_one_range(monkeypatch):
    draw = random.Random(7)
    for trial in range(300):
        monkeypatch.setattr(mesh_files, "BLOCK", draw.choice((1, 2, 3, 5, 100)))
        data = "".join(draw.choice(["a", "b ", "\n", "\n", "\r\n", "\\\n", "\\\r\n", "\\"]) for _ in range(draw.randint(0, 40))).encode()
        for continued in (False, True):
            whole = list(text_lines(io.BytesIO(data), 0, len(data), continued))
            cuts = sorted({0, len(data), *(draw.randint(0, len(data)) for _ in range(draw.randint(0, 6)))})
            parts = [line for a, b in zip(cuts, cuts[1:], strict=False) for line in text_lines(io.BytesIO(data), a, b, continued)]
            assert parts == whole, (data, cuts, continued)
            if not continued:
                assert whole == (data[:-1] if data.endswith(b"\n") else data).split(b"\n") or not data


def meshes(spark, folder, files, split_bytes=60):
    rows = []
    for name, content in files.items():
        (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())
        rows.append((name, str(folder / name)))
    return load_meshes(spark.createDataFrame(rows, "mesh_id string, path string"), split_bytes)


def collected(loaded):
    vertices, faces = {}, {}
    for r in loaded.vertices.collect():
        vertices.setdefault(r.mesh_id, {})[r.vertex_id] = (r.x, r.y, r.z)
    for r in loaded.faces.collect():
        faces.setdefault(r.mesh_id, {})[r.face_id] = (r.a, r.b, r.c)
    for table in (vertices, faces):
        for rows in table.values():
            assert sorted(rows) == list(range(len(rows)))
    return vertices, faces


def test_text_meshes_are_split_with_indices_across_ranges(spark, tmp_path):
    draw = random.Random(3)
    points = [tuple(float(np.float32(draw.uniform(-9, 9))) for _ in range(3)) for _ in range(60)]
    obj, fans, seen = ["# head", "mtllib x", ""], [], 0
    for number, p in enumerate(points):
        obj.append("v " + " ".join(map(repr, p)) + (" 1.0" if number % 5 else ""))
        seen += 1
        if number % 3 == 2:
            corners = [draw.randrange(seen) for _ in range(draw.randint(3, 6))]
            words = [str(c - seen) if draw.random() < 0.5 else f"{c + 1}/{c}/7" for c in corners]
            cut = draw.randint(1, len(words))
            obj.append("f " + " ".join(words[:cut]) + (" \\\n  " + " ".join(words[cut:]) if draw.random() < 0.5 else " " + " ".join(words[cut:])))
            fans += [(corners[0], corners[n], corners[n + 1]) for n in range(1, len(corners) - 1)]
    polygons = [[draw.randrange(60) for _ in range(draw.randint(3, 5))] for _ in range(25)]
    ply = "ply\nformat ascii 1.0\ncomment c\nelement vertex 60\nproperty float z\nproperty uchar red\nproperty float x\nproperty float y\n"
    ply += "element face 25\nproperty list uchar int vertex_indices\nelement edge 1\nproperty int a\nend_header\n"
    ply += "".join(f"{p[2]!r} 7 {p[0]!r} {p[1]!r}\n" + "\n" * (n % 7 == 0) for n, p in enumerate(points))
    ply += "".join(f"{len(p)} " + " ".join(map(str, p)) + "\n" for p in polygons) + "5\n"
    stl = "solid s\n" + "".join(
        "facet normal 0 0 1\n outer loop\n" + "".join("  vertex " + " ".join(map(repr, p)) + "\n" for p in points[n : n + 3]) + " endloop\nendfacet\n"
        for n in range(0, 60, 3)
    )
    for split_bytes in (60, 1 << 20):
        loaded = meshes(spark, tmp_path, {"a.obj": "\n".join(obj), "b.ply": ply, "c.STL": stl}, split_bytes)
        assert {r.status for r in loaded.statuses.collect()} == {"loaded"}
        vertices, faces = collected(loaded)
        assert all([v[n] for n in range(60)] == points for v in vertices.values()) and set(vertices) == {"a.obj", "b.ply", "c.STL"}
        assert list(dict(sorted(faces["a.obj"].items())).values()) == fans
        assert list(dict(sorted(faces["b.ply"].items())).values()) == [(p[0], p[n], p[n + 1]) for p in polygons for n in range(1, len(p) - 1)]
        assert faces["c.STL"] == {n: (3 * n, 3 * n + 1, 3 * n + 2) for n in range(20)}


def test_binary_meshes_and_mixed_polygons(spark, tmp_path):
    points = np.arange(30, dtype="<f4").reshape(10, 3)
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 10\nproperty float x\nproperty float y\nproperty float z\nelement face {}\nproperty list uchar int vertex_indices\nend_header\n"
    triangles = np.zeros(8, np.dtype([("n", "u1"), ("v", "<i4", 3)]))
    triangles["n"], triangles["v"] = 3, np.arange(24).reshape(8, 3) % 10
    mixed = b"".join(bytes([n]) + np.arange(n, dtype="<i4").tobytes() for n in (3, 5, 4))
    facets = np.zeros(6, np.dtype([("normal", "<f4", 3), ("points", "<f4", (3, 3)), ("extra", "<u2")]))
    facets["points"] = np.arange(54).reshape(6, 3, 3)
    files = {
        "fixed.ply": head.format(8).encode() + points.tobytes() + triangles.tobytes(),
        "mixed.ply": head.format(3).encode() + points.tobytes() + mixed,
        "points.ply": head.split("element face")[0].encode() + b"end_header\n" + points.tobytes(),
        "bin.stl": bytes(80) + (6).to_bytes(4, "little") + facets.tobytes(),
    }
    vertices, faces = collected(meshes(spark, tmp_path, files))
    assert all(list(dict(sorted(vertices[n].items())).values()) == list(map(tuple, points.tolist())) for n in ("fixed.ply", "mixed.ply", "points.ply"))
    assert [faces["fixed.ply"][n] for n in range(8)] == list(map(tuple, triangles["v"].tolist()))
    assert [faces["mixed.ply"][n] for n in range(6)] == [(0, 1, 2), (0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 1, 2), (0, 2, 3)]
    assert len(vertices["bin.stl"]) == 18 and faces["bin.stl"][5] == (15, 16, 17) and "points.ply" not in faces


def test_a_bad_file_is_a_row_and_stops_no_other(spark, tmp_path):
    head = "ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int v\nend_header\n"
    files = {
        "good.obj": "v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n",
        "number.obj": "v 0 0 0\n" * 30 + "v 0 zero 0\n",
        "corner.obj": "v 0 0 0\n" * 30 + "f 1 x 2\n",
        "short.ply": head + "0 0 0\n",
        "faceless.ply": head + "0 0 0\n1 1 1\n",
        "narrow.ply": head + "0 0 0\n1 1\n3 0 1 0\n",
        "odd.stl": "solid\nvertex 0 0 0\nvertex 1 1 1\n",
        "junk.stl": "junk",
        "junk.ply": "junk",
        "torn.ply": head.replace("ascii", "binary_little_endian") + "123",
        "empty.obj": "",
        "model.glb": "glTF",
    }
    loaded = meshes(spark, tmp_path, files)
    found = {r.mesh_id: r.status for r in loaded.statuses.collect()}
    assert {name for name, status in found.items() if status == "loaded"} == {"good.obj", "empty.obj"} and set(found) == set(files)
    assert all(r.reason for r in loaded.statuses.collect() if r.status == "failed")
    vertices, faces = collected(loaded)
    assert set(vertices) == set(faces) == {"good.obj"}
    twice = spark.createDataFrame([("m", str(tmp_path / "good.obj")), ("m", "x.obj"), ("n", str(tmp_path / "gone.obj"))], "mesh_id string, path string")
    assert {(r.mesh_id, r.status) for r in load_meshes(twice).statuses.collect()} == {("m", "failed"), ("n", "failed")}
    assert load_meshes(twice.limit(0)).statuses.count() == 0


@pytest.mark.parametrize("split_bytes", [7, 1000])
def test_lines_without_an_end_and_windows_line_ends(spark, tmp_path, split_bytes):
    loaded = meshes(spark, tmp_path, {"a.obj": "v 0 0 0\r\nv 1 0 0\r\nv 0 1 0\r\nf 1 \\\r\n2 -1"}, split_bytes)
    assert collected(loaded)[1] == {"a.obj": {0: (0, 1, 2)}}


class Counted(io.BytesIO):
    told = 0

    def read(self, size=-1):
        block = super().read(size)
        self.told += len(block)
        return block


@pytest.mark.parametrize("data", [b"v 1.25 2.5 3.75\n" * 60_000, b"v" * 900_000, b"f 1 2 \\\n" * 100_000], ids=["short", "one line", "continued"])
def test_all_ranges_together_read_about_the_file(data):
    for continued in (False, True):
        told, lines, range_bytes = 0, 0, 6000
        for low in range(0, len(data), range_bytes):
            handle = Counted(data)
            for line in text_lines(handle, low, min(low + range_bytes, len(data)), continued):
                lines += 1
            told += handle.told
        assert told < 4 * len(data)
        assert lines == (1 if continued and b"\\" in data else max(1, data.count(b"\n")))


def test_many_small_ranges_are_read_by_few_tasks(spark, tmp_path):
    few = spark.sparkContext.defaultParallelism * 4
    text = "\n".join(f"v {n} 0 0" for n in range(20 * few)) + "\nf 1 2 3" * 20 * few
    loaded = meshes(spark, tmp_path, {"a.obj": text}, 9)
    assert len(loaded.vertices.inputFiles()) <= few + 8  # those of failures besides
    assert loaded.vertices.count() == loaded.faces.count() == 20 * few
