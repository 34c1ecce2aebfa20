from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.voxel_files import sphere, write_vxz
from voxspark.operators.constraints import validate_voxels
from voxspark.plans.decode import decode_corpus, outcome_counts
from voxspark.plans.prepare import prepare, stored_slice
from voxspark.plans.store import store_table
from voxspark.sinks.ply import ply_rows, write_ply
from voxspark.sources.files import FileSplit, open_file, pack, read_range
from voxspark.sources.vxz import corpus_files, decode, listed_files, read_headers
from voxspark.sources.vxz_format import locate, octree_leaves, read_header
from voxspark.streaming.ingest import ingest

CELLS = [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1)]
DUAL = [(10, 20, 30), (40, 50, 60), (70, 80, 90), (100, 110, 120)]


def random_model(seed: int, count: int = 300, size: int = 20):
    rng = np.random.default_rng(seed)
    cells = np.unique(rng.integers(0, size, (count, 3)), axis=0)
    dual = rng.integers(0, 256, (len(cells), 3))
    return cells, dual, rng.integers(0, 64, len(cells)), rng.integers(0, 4, len(cells)), rng.integers(0, 4, len(cells))


@pytest.mark.parametrize("layout", ["all", "as_is", "none"])
@pytest.mark.parametrize("compression", ["none", "deflate", "lzma", "zstd"])
def test_every_layout_and_codec_gives_the_written_voxels(spark, tmp_path, layout, compression):
    cells, dual, flags, types, ranks = random_model(7)
    order = write_vxz(tmp_path / "m.vxz", cells, dual, flags, types, ranks, 8, compression, layout)
    rows = spark.read.format("vxz").load(str(tmp_path)).orderBy("chunk_no", "chunk_rank").collect()
    assert [(r.x, r.y, r.z) for r in rows] == [tuple(cells[i]) for i in order]
    assert [(r.dx, r.dy, r.dz, r.flags, r.ovoxel_type, r.qef_rank) for r in rows] == [
        (*dual[i], flags[i], types[i], ranks[i]) for i in order
    ]


def test_four_voxels_with_and_without_optional_attributes(spark, tmp_path):
    write_vxz(tmp_path / "plain.vxz", CELLS, DUAL, [1, 0, 0, 0], chunk_size=2)
    write_vxz(tmp_path / "sub/full.vxz", CELLS, DUAL, [1, 0, 0, 0], [0, 1, 2, 3], [3, 2, 1, 0], chunk_size=2)
    rows = spark.read.format("vxz").load(str(tmp_path)).orderBy("model_id", "x", "y", "z").collect()
    assert [r.model_id for r in rows] == ["plain"] * 4 + ["sub/full"] * 4
    assert [(r.dx, r.dy, r.dz) for r in rows[:4]] == DUAL
    assert [r.ovoxel_type for r in rows] == [None] * 4 + [0, 1, 2, 3]
    assert [r.qef_rank for r in rows] == [None] * 4 + [3, 2, 1, 0]


def test_pushed_filters_prune_and_stay_exact(spark, tmp_path):
    cells, dual, flags, *_ = random_model(3, 2000, 40)
    write_vxz(tmp_path / "a.vxz", cells, dual, flags, chunk_size=8)
    write_vxz(tmp_path / "b.vxz", cells[:50], dual[:50], flags[:50], chunk_size=8)
    voxels = spark.read.format("vxz").option("splitBytes", "2000").load(str(tmp_path))
    assert voxels.count() == len(cells) + 50
    found = voxels.where("model_id = 'a' AND z = 17 AND x > 5 AND x <= 30")
    expected = ((cells[:, 2] == 17) & (cells[:, 0] > 5) & (cells[:, 0] <= 30)).sum()
    assert found.count() == expected


@pytest.mark.parametrize(
    ("changes", "message"),
    [
        ({"num_voxel": 0}, "no voxels"),
        ({"chunk_size": 3}, "power of two"),
        ({"filter": "x"}, "unsupported filter"),
        ({"attr": [["dual_vertices", 2], ["intersected", 1]]}, "dual_vertices"),
    ],
)
def test_bad_headers_are_reported_per_file(spark, tmp_path, changes, message):
    write_vxz(tmp_path / "bad.vxz", CELLS, DUAL, [0] * 4, chunk_size=2, changes=changes)
    write_vxz(tmp_path / "good.vxz", CELLS, DUAL, [0] * 4, chunk_size=2)
    (tmp_path / "junk.vxz").write_bytes(b"nothing")
    headers = {r.model_id: r for r in read_headers(corpus_files(spark, str(tmp_path))).collect()}
    assert message in headers["bad"].error
    assert "not a voxel file" in headers["junk"].error
    assert headers["good"].error is None and headers["good"].num_voxel == 4
    assert headers["good"].attributes[0].name == "dual_vertices"
    decoded = decode(corpus_files(spark, str(tmp_path)))
    assert decoded.where("error IS NULL").count() == 4
    assert {r.model_id for r in decoded.where("error IS NOT NULL").collect()} == {"bad", "junk"}


def test_every_listed_file_has_a_status(spark, tmp_path):
    cells, dual, flags = sphere(12, 4.0)
    write_vxz(tmp_path / "in/good.vxz", cells, dual, flags, chunk_size=4, compression="deflate")
    content = (tmp_path / "in/good.vxz").read_bytes()
    (tmp_path / "in/torn.vxz").write_bytes(content[:-40] + bytes(40))
    (tmp_path / "in/empty.vxz").write_bytes(b"")
    write_vxz(tmp_path / "in/hollow.vxz", cells, dual, flags, chunk_size=4, changes={"chunks": []})
    write_vxz(tmp_path / "in/bare.vxz", np.empty((0, 3), int), np.empty((0, 3), int), np.empty(0, int), changes={"num_voxel": 4})
    write_vxz(tmp_path / "in/wide.vxz", cells, dual, flags, chunk_size=4, changes={"num_voxel": 1 << 80})
    (tmp_path / "list.txt").write_text("in/good.vxz\nin/torn.vxz\nin/empty.vxz\nin/hollow.vxz\nin/bare.vxz\nin/wide.vxz\na/x.vxz\nb/x.vxz\nt.txt\n")
    files = listed_files(spark, str(tmp_path / "list.txt"), str(tmp_path))
    found = {r.model_id: (r.status, r.reason) for r in decode_corpus(files, str(tmp_path / "out"), skip_existing=True).collect()}
    assert found.pop("good") == ("decoded", None)
    assert found["x"] == ("failed", "duplicate stem") and found["t"] == ("failed", "not a .vxz path")
    assert set(found) == {"torn", "empty", "hollow", "bare", "wide", "x", "t"} and {s for s, _ in found.values()} == {"failed"}


def test_model_without_a_voxel_breaks_the_announced_count(spark):
    voxels = spark.createDataFrame([("a", 0, 0, 0, None, None)], "model_id string, x int, y int, z int, ovoxel_type short, qef_rank short")
    models = spark.createDataFrame([("a", 4, 1), ("b", None, 4)], "model_id string, resolution int, num_voxel long")
    broken = validate_voxels(voxels, models).where("violations > 0").collect()
    assert [(r.model_id, r.rule) for r in broken] == [("b", "voxel_count")]


def test_out_of_range_attribute_fails_its_file(spark, tmp_path):
    write_vxz(tmp_path / "m.vxz", CELLS, DUAL, [0] * 4, [0, 1, 2, 4], chunk_size=2)
    errors = decode(corpus_files(spark, str(tmp_path))).where("error IS NOT NULL").collect()
    assert len(errors) == 1 and "ovoxel_type" in errors[0].error


def test_text_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# all\na/one.vxz # first\n\n/abs/two.vxz\nthree.txt\nb/one.vxz\n")
    rows = {r.path: r.problem for r in listed_files(spark, str(tmp_path / "list.txt"), "/data").collect()}
    assert rows == {
        "/data/a/one.vxz": "duplicate stem",
        "/data/b/one.vxz": "duplicate stem",
        "/abs/two.vxz": None,
        "/data/three.txt": "not a .vxz path",
    }


def read_ply(path):
    raw = path.read_bytes()
    end = raw.index(b"end_header\n") + len(b"end_header\n")
    lines = raw[:end].decode().splitlines()
    vertices = int(next(x for x in lines if x.startswith("element vertex")).split()[-1])
    faces = int(next(x for x in lines if x.startswith("element face")).split()[-1])
    points = np.frombuffer(raw, "<f4", 3 * vertices, end).reshape(-1, 3)
    records = np.frombuffer(raw, np.dtype([("n", "u1"), ("v", "<i4", 3)]), faces, end + 12 * vertices)
    assert len(raw) == end + 12 * vertices + 13 * faces and (records["n"] == 3).all()
    return points, records["v"]


def test_batch_decode_writes_exact_meshes_and_statuses(spark, tmp_path):
    cells, dual, flags = sphere(24, 9.0)
    source, target = tmp_path / "in", tmp_path / "out"
    order = write_vxz(source / "deep/ball.vxz", cells, dual, flags, chunk_size=8, compression="deflate")
    write_vxz(source / "loose.vxz", CELLS, DUAL, [0] * 4, chunk_size=2)
    (source / "junk.vxz").write_bytes(b"junk")
    files = corpus_files(spark, str(source))
    statuses = decode_corpus(files, str(target))
    found = {r.model_id: (r.status, r.reason) for r in statuses.collect()}
    assert found["deep/ball"] == ("decoded", None)
    assert found["loose"] == ("failed", "no quads")
    assert found["junk"][0] == "failed"
    assert outcome_counts(statuses).first().asDict() == {"decoded": 1, "skipped": 0, "failed": 2, "total": 3}

    points, faces = read_ply(target / "deep/ball.ply")
    local = cells[order].astype(np.float32) + np.float32(128) / np.float32(255)
    expected = local / np.float32(cells.max() + 1) - np.float32(0.5)
    assert (points == expected).all()
    # A closed surface: every directed edge once, with its reverse, and Euler characteristic 2.
    edges = {(int(f[i]), int(f[(i + 1) % 3])) for f in faces for i in range(3)}
    assert len(edges) == 3 * len(faces) and all((b, a) in edges for a, b in edges)
    assert len(points) - len(edges) // 2 + len(faces) == 2
    assert [p for p in target.rglob("*") if p.name.endswith(".tmp")] == []

    again = decode_corpus(files, str(target), skip_existing=True)
    assert outcome_counts(again).first().skipped == 1

    mesh = spark.read.format("mesh").option("splitBytes", "4000").load(str(target))
    assert mesh.count() == len(points)
    read_back = spark.read.format("mesh").option("content", "faces").option("splitBytes", "4000").load(str(target))
    assert [(r.a, r.b, r.c) for r in read_back.orderBy("face_id").collect()] == [tuple(f) for f in faces.tolist()]


def ply_tables(spark, meshes):
    """Tables that the sink takes, their rows in no order, of (name, points, corners)."""
    rng = np.random.default_rng(3)
    sides = [[], []]
    for name, points, corners in meshes:
        for side, rows in zip(sides, (points, corners)):
            side += [(name, n, *rows[n].tolist()) for n in rng.permutation(len(rows)).tolist()]
    return (
        spark.createDataFrame([(name, f"{name}.vxz", 8) for name, *_ in meshes], "mesh_id string, source string, resolution int"),
        spark.createDataFrame(sides[0], "mesh_id string, vertex_id long, x float, y float, z float").repartition(5),
        spark.createDataFrame(sides[1], "mesh_id string, face_id long, a long, b long, c long").repartition(7),
    )


def test_ply_records_travel_by_stretches_of_the_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    sizes = {"big": (12_000, 25_000), "deep/one": (1, 2), "points": (30, 0), **{f"s{n}": (3, 2) for n in range(20)}}
    made = [(name, rng.random((v, 3), np.float32), rng.integers(0, v, (f, 3))) for name, (v, f) in sizes.items()]
    tables = ply_tables(spark, made)
    total = 12_000 * 12 + 25_000 * 13
    assert total // (1 << 17) + len(sizes) <= ply_rows(*tables).count() <= total // (1 << 17) + 1 + len(sizes)
    write_ply(*tables, str(tmp_path))
    assert len([p for p in tmp_path.rglob("*") if p.is_file()]) == len(sizes)
    for name, points, corners in made:
        found = read_ply(tmp_path / f"{name}.ply")
        assert (found[0] == points).all() and (found[1] == corners).all()


@pytest.mark.parametrize("column", ["face_id", "c"])
def test_ply_of_a_face_with_a_null_leaves_no_file(spark, tmp_path, column):
    meshes, vertices, faces = ply_tables(spark, [("m", np.ones((5, 3), np.float32), np.zeros((4, 3), np.int64))])
    with pytest.raises(Exception, match="NULL in it"):
        write_ply(meshes, vertices, faces.withColumn(column, F.when(F.col("face_id") != 3, F.col(column))), str(tmp_path))
    assert [p for p in tmp_path.rglob("*") if p.name == "m.ply"] == []


def test_small_mesh_files_share_a_task(spark, tmp_path):
    made = [(f"s{n:02}", np.full((4, 3), n, np.float32), np.full((3, 3), n)) for n in range(40)]
    write_ply(*ply_tables(spark, made), str(tmp_path))
    for content, size in (("vertices", 4), ("faces", 3)):
        table = spark.read.format("mesh").option("content", content).load(str(tmp_path))
        assert table.rdd.getNumPartitions() == 1
        column = "x" if content == "vertices" else "a"
        assert sorted((r.mesh_id, r[1], r[column]) for r in table.collect()) == [(f"s{n:02}.ply", k, n) for n in range(40) for k in range(size)]
    split = spark.read.format("mesh").option("splitBytes", "100").load(str(tmp_path))
    assert split.count() == 160
    sizes = [1, 5 << 20, 1, 2 << 20, 3 << 20, 0, 4 << 20]
    groups = pack([FileSplit(str(n), str(n), size, 0, 1) for n, size in enumerate(sizes)])
    assert [[s.size for s in g.splits] for g in groups] == [[1], [5 << 20], [1, 2 << 20], [3 << 20, 0], [4 << 20]]


def test_exact_meshes_take_grids_that_the_preview_store_refuses(spark, tmp_path):
    for name, x in (("near", 100), ("far", 70_000), ("last", (1 << 21) - 1), ("beyond", 1 << 21)):
        cells = [(x, y, z) for _, y, z in CELLS]
        write_vxz(tmp_path / f"in/{name}.vxz", cells, DUAL, [1, 0, 0, 0], chunk_size=2)
    files = corpus_files(spark, str(tmp_path / "in"))
    found = {r.model_id: (r.status, r.reason) for r in decode_corpus(files, str(tmp_path / "out")).collect()}
    assert found.pop("beyond") == ("failed", "key_range")
    assert found == dict.fromkeys(("near", "far", "last"), ("decoded", None))
    assert len(read_ply(tmp_path / "out/far.ply")[1]) == 2
    prepared = {r.model_id: r.status for r in prepare(files, str(tmp_path / "store")).collect()}
    assert prepared == {"near": "ready", "far": "failed", "last": "failed", "beyond": "failed"}


def test_prepared_store_and_stream(spark, tmp_path):
    cells, dual, flags = sphere(20, 7.0)
    source, store = tmp_path / "in", str(tmp_path / "store")
    write_vxz(source / "0012.vxz", cells, dual, flags, chunk_size=8)
    files = corpus_files(spark, str(source))
    assert [r.status for r in prepare(files, store, point_budget=100, face_budget=200).collect()] == ["ready"]
    metadata = store_table(spark, store, "metadata").first()
    assert metadata.source_name == "0012.vxz"
    assert metadata.model_id == "0012" and metadata.resolution_source == "inferred"
    assert metadata.voxel_count == len(cells) and metadata.face_count == 2 * (len(cells) - 2)
    assert metadata.cluster_width == int(np.ceil(np.sqrt(metadata.face_count / 200)))
    assert metadata.preview_voxel_count == store_table(spark, store, "voxel_overview").count()
    assert metadata.preview_face_count == store_table(spark, store, "lod_faces").count() > 0
    assert not metadata.has_qef_rank and list(metadata.ovoxel_type_counts) == [0, 0, 0, 0]
    rows = stored_slice(spark, store, "0012", "y", 9)
    assert rows.count() == (cells[:, 1] == 9).sum()
    with pytest.raises(ValueError, match="slice index"):
        stored_slice(spark, store, "0012", "y", 99)
    assert [r.status for r in prepare(files, store, point_budget=100, face_budget=200).collect()] == ["kept"]

    (source / "copy.vxz").write_bytes((source / "0012.vxz").read_bytes())
    streamed = str(tmp_path / "streamed")
    for _ in range(2):
        query = ingest(spark, str(source), streamed, str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        assert query.exception() is None
    prepared = store_table(spark, streamed, "metadata").collect()
    assert len(prepared) == 1 and len(prepared[0].model_id) == 64


@pytest.mark.parametrize("fortran", [False, True])
@pytest.mark.parametrize("dtype", ["<i4", ">u2", "|b1", "<f2", ">f8", "<i8", "|i1", "<u8"])
def test_volumes_of_every_dtype_and_order(spark, tmp_path, dtype, fortran):
    values = (np.arange(5 * 6 * 7).reshape(5, 6, 7) % 3).astype(dtype)
    np.save(tmp_path / "004_final_labels.npy", np.asfortranarray(values) if fortran else values)
    reader = spark.read.format("npy").option("splitBytes", "100")
    cells = reader.load(str(tmp_path)).collect()
    assert {(r.i, r.j, r.k): r.value for r in cells} == {n: float(v) for n, v in np.ndenumerate(values)}
    assert len(cells) == values.size
    axis = "k" if fortran else "i"
    assert reader.load(str(tmp_path)).where(F.col(axis) == 3).count() == values.size // (7 if fortran else 5)
    volume = spark.read.format("npy").option("content", "volumes").load(str(tmp_path)).first()
    assert (volume.nx, volume.ny, volume.nz, volume.fortran_order) == (5, 6, 7, fortran)
    assert volume.visualization == "pipelineLabels" and volume.error is None


def test_unusable_volumes(spark, tmp_path):
    np.save(tmp_path / "other.npy", np.zeros((2, 2, 2)))
    np.save(tmp_path / "001_closed_boundary.npy", np.zeros((2, 2)))
    (tmp_path / "999_scalar_field.npy").write_bytes(b"text")
    rows = spark.read.format("npy").option("content", "volumes").load(str(tmp_path)).collect()
    errors = {r.volume_id: r.error for r in rows}
    assert "name" in errors["other"] and "three dimensions" in errors["001_closed_boundary"]
    assert "not a NumPy file" in errors["999_scalar_field"]
    assert spark.read.format("npy").option("skipInvalid", "true").load(str(tmp_path)).count() == 0


def test_text_meshes(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\nf -4 -2 -1\n")
    (tmp_path / "b.ply").write_text(
        "ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\n"
        "element face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n"
    )
    (tmp_path / "c.stl").write_text(
        "solid t\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid t\n"
    )
    vertices = spark.read.format("mesh").load(str(tmp_path)).orderBy("mesh_id", "vertex_id").collect()
    assert [(r.mesh_id, r.vertex_id) for r in vertices] == [
        *[("a.obj", n) for n in range(4)],
        *[("b.ply", n) for n in range(4)],
        *[("c.stl", n) for n in range(3)],
    ]
    faces = spark.read.format("mesh").option("content", "faces").load(str(tmp_path)).orderBy("mesh_id", "face_id").collect()
    assert [(r.mesh_id, r.a, r.b, r.c) for r in faces] == [
        ("a.obj", 0, 1, 2),
        ("a.obj", 0, 2, 3),
        ("a.obj", 0, 2, 3),
        ("b.ply", 0, 1, 2),
        ("b.ply", 0, 2, 3),
        ("c.stl", 0, 1, 2),
    ]


def test_ply_with_a_long_header(spark, tmp_path):
    lines = ["ply", "format ascii 1.0", *["comment " + "x" * 90] * 2000, "element vertex 1"]
    lines += [f"property float {c}" for c in "xyz"] + ["end_header", "1 2 3"]
    (tmp_path / "long.ply").write_text("\n".join(lines) + "\n")
    assert [(r.x, r.y, r.z) for r in spark.read.format("mesh").load(str(tmp_path)).collect()] == [(1.0, 2.0, 3.0)]


def test_mesh_files_that_cannot_be_read_are_told(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v 0 0 0\n")
    (tmp_path / "b.ply").write_text("no mesh")
    (tmp_path / "c.glb").write_bytes(b"glTF")
    errors = {r.mesh_id: r.error for r in spark.read.format("mesh").option("content", "files").load(str(tmp_path)).collect()}
    assert errors["a.obj"] is None and "not a PLY file" in errors["b.ply"] and "unsupported" in errors["c.glb"]


def walked_leaves(tree, depth):
    """Leaves of a depth-first octree, node by node."""
    found, position = [], 0

    def walk(level, code):
        nonlocal position
        mask = tree[position]
        position += 1
        for child in range(8):
            if mask >> child & 1:
                walk(level + 1, code << 3 | child) if level < depth - 1 else found.append(code << 3 | child)

    walk(0, 0)
    return found, position


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 6])
def test_octrees_are_decoded_and_pruned_like_a_walk(depth):
    rng = np.random.default_rng(depth)
    for trial in range(30):
        tree = rng.integers(0, 256, 6000, dtype=np.uint8) & rng.integers(0, 256, 6000, dtype=np.uint8)
        tree[rng.random(6000) < 0.1] = 0
        try:
            expected, used = walked_leaves(tree, depth)
        except IndexError:
            with pytest.raises(ValueError, match="ends early"):
                octree_leaves(tree, depth)
            continue
        leaves = octree_leaves(tree[:used], depth)
        assert leaves.codes.tolist() == expected and leaves.ranks.tolist() == list(range(len(expected))) and leaves.total == len(expected)
        assert leaves.visited == used
        with pytest.raises(ValueError, match="trailing" if used < len(tree) else "early"):
            octree_leaves(tree[: used + 1] if used < len(tree) else tree[:-1], depth)
        side = 1 << depth
        bounds = [sorted(rng.integers(-1, side + 2, 2).tolist()) for _ in range(3)]
        cells = np.stack([sum((np.array(expected, int) >> 3 * b + o & 1) << b for b in range(depth)) for o in (2, 1, 0)]) if expected else np.empty((3, 0), int)
        inside = np.all([(c >= low) & (c < high) for c, (low, high) in zip(cells, bounds)], axis=0)
        pruned = octree_leaves(tree[:used], depth, bounds)
        assert pruned.codes.tolist() == np.array(expected, int)[inside].tolist() and pruned.ranks.tolist() == np.flatnonzero(inside).tolist()
        assert pruned.visited <= used and pruned.total == len(expected)


def test_bounded_decode_looks_at_few_nodes_and_keeps_ranks(spark, tmp_path):
    cells, dual, flags = sphere(64, 25.0)
    write_vxz(tmp_path / "ball.vxz", cells, dual, flags, chunk_size=64)
    files = corpus_files(spark, str(tmp_path))
    whole = {(r.x, r.y, r.z): (r.chunk_rank, r.dx, r.flags) for r in decode(files).collect()}
    part = decode(files, bounds={"z": (9, 10), "x": (0, 40)}).collect()
    assert {(r.x, r.y, r.z): (r.chunk_rank, r.dx, r.flags) for r in part} == {c: v for c, v in whole.items() if c[2] == 9 and c[0] < 40}
    with open_file(str(tmp_path / "ball.vxz")) as handle:
        header = read_header(handle)
        start, length = locate(header, 0, handle.size()).streams["svo"]
        tree = np.frombuffer(read_range(handle, start, length), np.uint8)
    assert octree_leaves(tree, 6, [(0, 64), (0, 64), (9, 10)]).visited < len(tree) / 10
    with pytest.raises(ValueError, match="no axes"):
        decode(files, bounds={"k": (0, 1)})
