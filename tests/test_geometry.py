from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import meshes as mesh_checks
from voxspark.functions import geometry as g
from voxspark.functions import labels
from voxspark.functions.text import bytes_text, folder_label, parse_resolution, safe_file_name
from voxspark.operators import lod, meshes, slices, summary, topology
from voxspark.operators.lookup import lookup_join
from voxspark.operators.ordinals import dense_ordinals


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(n) for n, v in inputs.items()] or ["id"])
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(("axis", "cell"), [("x", (3, 5, 5)), ("y", (5, 3, 5)), ("z", (5, 5, 3))])
def test_pixels_and_cells(spark, axis, cell):
    grid = g.pixel_to_grid(axis, F.lit(3), F.lit(5), F.lit(2), F.lit(8))
    assert tuple(value(spark, c) for c in grid) == cell
    px, py = g.grid_to_pixel(axis, F.lit(2), F.lit(5), F.lit(6), F.lit(8))
    back = g.pixel_to_grid(axis, F.lit({"x": 2, "y": 5, "z": 6}[axis]), px, py, F.lit(8))
    assert tuple(value(spark, c) for c in back) == (2, 5, 6)


def test_centers_and_planes(spark):
    assert value(spark, g.cell_center(F.lit(0), F.lit(8))) == -0.4375
    assert value(spark, g.cell_center(F.lit(7), F.lit(8))) == 0.4375
    assert value(spark, g.node_position(F.lit(0), F.lit(1))) == 0.0
    with pytest.raises(ValueError):
        g.check_axis("w")
    with pytest.raises(Exception, match="unknown axis"):
        value(spark, g.axis_index(F.lit("w")))


@pytest.mark.parametrize(
    ("axis", "coords", "dual", "pixel", "plane"),
    [
        ("z", (1, 2, 3), (128, 64, 255), (1.50196, 1.74902), (-0.24902, 0.12549)),
        ("x", (1, 2, 0), (51, 102, 153), (0.6, 1.6), (-0.7, 0.2)),
    ],
)
def test_dual_projection(spark, axis, coords, dual, pixel, plane):
    found = g.dual_to_slice(axis, [F.lit(c) for c in coords], [F.lit(d) for d in dual], F.lit(4))
    got = [value(spark, found[n]) for n in ("pixel_x", "pixel_y", "plane_x", "plane_y")]
    assert got == pytest.approx([*pixel, *plane], abs=1e-5)


def test_overlay_scale(spark):
    assert [value(spark, g.overlay_scale(F.lit(r))) for r in (1536, 2048, 2049, 4096)] == [2, 2, 1, 1]


def test_single_precision_positions_match_numpy(spark):
    rng = np.random.default_rng(1)
    coords, duals = rng.integers(0, 1536, 5000), rng.integers(0, 256, 5000)
    frame = spark.createDataFrame(list(zip(coords.tolist(), duals.tolist())), "c int, d int")
    rows = frame.select(
        g.dual_position_f32("c", "d", F.lit(1536)).alias("p"), g.split_position_f32("c", "d", F.lit(1536)).alias("s")
    ).collect()
    local = coords.astype(np.float32) + duals.astype(np.float32) / np.float32(255)
    assert (np.array([r.p for r in rows], np.float32) == local / np.float32(1536) - np.float32(0.5)).all()
    assert (np.array([r.s for r in rows], np.float32) == local * np.float32(1 / 1536) - np.float32(0.5)).all()


def voxel_frame(spark, cells, duals, flags, model="m"):
    rows = [(model, n, *c, *d, f) for n, (c, d, f) in enumerate(zip(cells, duals, flags))]
    return spark.createDataFrame(rows, "model_id string, vid long, x int, y int, z int, dx int, dy int, dz int, flags int")


SQUARE = [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)]


@pytest.mark.parametrize(("flag", "corners"), [(1, [0, 1, 2, 3]), (9, [0, 3, 2, 1]), (8, None)])
def test_edge_sign_orients_the_quad(spark, flag, corners):
    voxels = voxel_frame(spark, SQUARE, [(0, 0, 0)] * 4, [flag, 0, 0, 0])
    found = [[r.v0, r.v1, r.v2, r.v3] for r in topology.quads(voxels).collect()]
    assert found == ([] if corners is None else [corners])


def test_quads_across_block_borders_and_at_the_last_coordinate(spark):
    last = (1 << 21) - 1
    cells = [(63, 63, 63), (63, 63, 64), (63, 64, 64), (63, 64, 63), (last, last, last), (0, 0, 0)]
    voxels = voxel_frame(spark, cells, [(0, 0, 0)] * 6, [1, 0, 0, 0, 7, 0])
    assert [[r.v0, r.v1, r.v2, r.v3] for r in topology.quads(voxels).collect()] == [[0, 1, 2, 3]]


@pytest.mark.parametrize(
    ("cells", "duals", "resolution"),
    [
        (SQUARE, [(0, 0, 0)] * 4, 1),
        ([(520, 354, 776), (520, 354, 777), (520, 355, 777), (520, 355, 776)], [(225, 118, 135), (225, 246, 8), (225, 118, 135), (225, 127, 127)], 1536),
    ],
)
def test_split_goldens(spark, cells, duals, resolution):
    voxels = voxel_frame(spark, cells, duals, [1, 0, 0, 0])
    faces = topology.triangles(topology.quads(voxels, with_dual=True), F.lit(resolution)).orderBy("face_key").collect()
    assert [(r.a, r.b, r.c) for r in faces] == [(0, 1, 2), (0, 2, 3)]


def test_degenerate_corner_takes_the_other_split(spark):
    # Corners 0, 1 and 2 at one point: the first triangle has no area.
    cells = [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)]
    duals = [(0, 255, 255), (0, 255, 0), (0, 0, 0), (0, 9, 9)]
    voxels = voxel_frame(spark, cells, duals, [1, 0, 0, 0])
    faces = topology.triangles(topology.quads(voxels, with_dual=True), F.lit(1)).orderBy("face_key").collect()
    assert [(r.a, r.b, r.c) for r in faces] == [(0, 1, 3), (3, 1, 2)]


def test_random_quads_match_brute_force(spark):
    rng = np.random.default_rng(5)
    cells = np.unique(rng.integers(56, 72, (9000, 3)), axis=0)
    flags = rng.integers(0, 64, len(cells))
    voxels = voxel_frame(spark, cells.tolist(), [(0, 0, 0)] * len(cells), flags.tolist())
    index = {tuple(c): n for n, c in enumerate(cells.tolist())}
    around = [[(0, 0, 1), (0, 1, 1), (0, 1, 0)], [(1, 0, 0), (1, 0, 1), (0, 0, 1)], [(0, 1, 0), (1, 1, 0), (1, 0, 0)]]
    expected = set()
    for n, (cell, flag) in enumerate(zip(cells.tolist(), flags.tolist())):
        for axis in range(3):
            ring = [index.get(tuple(np.add(cell, step).tolist())) for step in around[axis]]
            if flag >> axis & 1 and None not in ring:
                expected.add((n, *(ring[::-1] if flag >> axis + 3 & 1 else ring)))
    found = {(r.v0, r.v1, r.v2, r.v3) for r in topology.quads(voxels).collect()}
    assert found == expected and len(found) > 1000


def test_distinct_triangles_of_the_largest_keys_keep_the_first_winding(spark):
    top = (1 << 63) - 1
    keys = [top, top - 1, top - 2, 0, 5]
    rng = np.random.default_rng(2)
    rows = [("m", int(n), *[keys[k] for k in rng.permutation(5)[:3]]) for n in rng.permutation(200)]
    rows += [("m", 900, 5, 5, top), ("m", 901, top, 5, 5), ("m", 902, 0, top, 0)]
    faces = spark.createDataFrame(rows, "model_id string, face_key long, a long, b long, c long")
    first = {}
    for _, key, *corners in sorted(rows):
        first.setdefault(tuple(sorted(corners)), (key, *corners))
    assert sorted((r.face_key, r.a, r.b, r.c) for r in topology.distinct_triangles(faces).collect()) == sorted(first.values())


def test_one_exchange_serves_all_four_corners(spark):
    voxels = voxel_frame(spark, SQUARE, [(0, 0, 0)] * 4, [1, 0, 0, 0])
    frame = topology.quads(voxels, with_dual=True)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") == 0
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 3


@pytest.fixture
def surface(spark, monkeypatch):
    """Voxels that the mesh queries read instead of the tables, and their faces and vertices, with no join broadcast."""
    rng = np.random.default_rng(9)
    cells = np.unique(np.concatenate([rng.integers(60, 68, (400, 3)), rng.integers(0, 3, (30, 3)) + (1 << 21) - 3]), axis=0)
    duals, flags = rng.choice([0, 1, 128, 255], (len(cells), 3)), rng.integers(0, 64, len(cells))
    voxels = voxel_frame(spark, cells.tolist(), duals.tolist(), flags.tolist())
    monkeypatch.setattr(mesh_checks.d, "voxels", lambda spark, sf: voxels)
    faces = topology.triangles(topology.quads(voxels, with_dual=True), F.lit(mesh_checks.R))
    vertices = voxels.select(
        F.col("model_id").alias("mesh_id"),
        F.col("vid").alias("vertex_id"),
        *[g.dual_position(c, f"d{c}", mesh_checks.R).alias(c) for c in "xyz"],
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield faces.withColumnsRenamed({"model_id": "mesh_id", "face_key": "face_id"}), vertices
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def added_exchanges(frame) -> int:
    """Exchanges besides the one that the quads are dealt by."""
    return frame._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")


def test_normals_of_voxel_models_shuffle_no_faces(spark, surface):
    found = mesh_checks.a15(spark, None)
    assert added_exchanges(found) == 1  # that of the sums
    sums = meshes.vertex_normal_sums(*surface).where("sqrt(nx * nx + ny * ny + nz * nz) > 1e-9")
    joined = {r.vertex_id: (r.nx, r.ny, r.nz) for r in meshes.unit_normals(sums).collect()}
    rows = {r.vertex_id: (r.nx, r.ny, r.nz) for r in found.collect()}
    assert len(rows) > 100 and rows.keys() == joined.keys()
    assert all(rows[n] == pytest.approx(joined[n], abs=1e-4) for n in rows)


def test_clipped_faces_of_voxel_models_shuffle_no_faces(spark, surface):
    found = mesh_checks.f4_faces(spark, None)
    assert added_exchanges(found) == 0
    joined = {r.face_id: r.clip for r in meshes.classify_faces(*surface, "x", -0.25).collect()}
    assert {r.face_id: r.clip for r in found.collect()} == joined and len(joined) > 50
    for cut in (1.5, 1.53125):
        placed = topology.placed_triangles(topology.quads(mesh_checks.d.voxels(spark, None), with_dual=True), F.lit(mesh_checks.R))
        placed = placed.withColumnsRenamed({"model_id": "mesh_id", "face_key": "face_id"})
        expected = {r.face_id: r.clip for r in meshes.classify_faces(*surface, "y", cut).collect()}
        assert {r.face_id: r.clip for r in meshes.classify_placed_faces(placed, "y", cut).collect()} == expected
        assert {"kept", "dropped", "cut"} == set(expected.values())


def test_cluster_boundary_and_distinct_faces(spark):
    voxels = voxel_frame(spark, [(1, 0, 0), (2, 0, 0)], [(255, 0, 0), (0, 0, 0)], [0, 0])
    grid = spark.createDataFrame([("m", 8, 2)], "model_id string, resolution int, cluster_width int")
    assert lod.cluster_vertices(voxels, grid).count() == 1
    rows = [("m", 0, 0, 1, 2), ("m", 1, 2, 1, 0), ("m", 2, 0, 2, 3), ("m", 3, 4, 4, 5)]
    faces = spark.createDataFrame(rows, "model_id string, face_key long, a long, b long, c long")
    kept = topology.distinct_triangles(topology.non_degenerate(faces)).orderBy("face_key").collect()
    assert [(r.a, r.b, r.c) for r in kept] == [(0, 1, 2), (0, 2, 3)]


def test_resolution_inferred_explicit_and_checked(spark):
    voxels = voxel_frame(spark, [(7, 0, 0)], [(0, 0, 0)], [0])
    inferred = summary.resolutions(voxels).first()
    assert (inferred.resolution, inferred.resolution_source) == (8, "inferred")
    wanted = spark.createDataFrame([("m", 16)], "model_id string, resolution int")
    explicit = summary.resolutions(voxels, wanted).first()
    assert (explicit.resolution, explicit.resolution_source) == (16, "explicit")


def test_dense_ordinals_cross_digits(spark):
    keys = sorted([0, 1, 5, (1 << 21) - 1, 1 << 21, (1 << 21) + 3, 1 << 42, (1 << 42) + (1 << 21), (1 << 62) + 9])
    frame = spark.createDataFrame([(m, k) for m in "ab" for k in keys], "model_id string, key long")
    found = {(r.model_id, r.key): r.ordinal for r in dense_ordinals(frame, "key", "ordinal").collect()}
    assert found == {(m, k): n for m in "ab" for n, k in enumerate(keys)}


def test_dense_ordinals_do_not_shuffle_rows_for_a_small_table_of_offsets(spark):
    frame = spark.range(1000).select(F.lit("m").alias("model_id"), (F.col("id") * (1 << 14)).alias("key"))
    numbered = dense_ordinals(frame, "key", "ordinal")
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert all(r.ordinal == r.key >> 14 for r in numbered.collect())


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_of_a_hot_key_keeps_every_equal_row(spark, how):
    facts = spark.range(3000).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id") % 50).alias("k"))
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 7).alias("w"))
    found = {(r.k, r.w): r.n for r in lookup_join(facts, lookup, ["k"], how).groupBy("k", "w").agg(F.count("*").alias("n")).collect()}
    assert found[(0, 0)] == 2700 + 60
    assert sum(found.values()) == 3000 - (60 if how == "inner" else 0)


def test_flag_bits_beyond_the_edges_do_not_change_quads(spark):
    cells = [(x, y, z) for x in range(3) for y in range(3) for z in range(3)]
    ends = []
    for extra in (0, 64, 192):
        voxels = voxel_frame(spark, cells, [(0, 0, 0)] * len(cells), [7 + extra] * len(cells))
        ends.append(sorted(map(str, topology.quads(voxels).select("vid", "axis", "v0", "v1", "v2", "v3").collect())))
    assert ends[0] and ends[0] == ends[1] == ends[2]


def test_coordinates_without_a_key_are_an_error(spark):
    for x in (-1, 1 << 21):
        voxels = spark.createDataFrame([("m", 0, x, 64, 64, 1, 128, 128, 128)], "model_id string, vid long, x int, y int, z int, flags int, dx int, dy int, dz int")
        with pytest.raises(Exception, match="21-bit key"):
            topology.quads(voxels).collect()


def test_faces_with_an_unknown_corner_are_named(spark):
    faces = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 0, 1, 9)], "mesh_id string, face_id long, a long, b long, c long")
    vertices = spark.createDataFrame([("m", n, 0.0, 0.0, float(n)) for n in range(3)], "mesh_id string, vertex_id long, x float, y float, z float")
    assert {r.face_id: r.clip for r in meshes.classify_faces(faces, vertices, "z", 1.0).collect()} == {0: "cut", 1: "unknown"}


def test_raster_has_every_pixel_and_the_last_voxel_wins(spark):
    voxels = voxel_frame(spark, [(2, 0, 3), (2, 0, 3), (2, 4, 0)], [(1, 1, 1), (9, 9, 9), (5, 5, 5)], [0, 0, 0])
    voxels = voxels.withColumns({"ovoxel_type": F.lit(None).cast("int"), "qef_rank": F.lit(None).cast("int")})
    sizes = spark.createDataFrame([("m", 6), ("empty", 3)], "model_id string, resolution int")
    pixels = slices.slice_pixels(slices.voxel_slice(voxels, "x", 2), sizes, "x")
    raster = slices.slice_raster(pixels, sizes, "dual").collect()
    assert len(raster) == 36 + 9 and len({(r.model_id, r.px, r.py) for r in raster}) == 45
    active = {(r.px, r.py): (r.r, r.g, r.b) for r in raster if r.active}
    assert active == {(3, 5): (9, 9, 9), (0, 1): (5, 5, 5)}
    assert {(r.r, r.g, r.b) for r in raster if not r.active} == {(244, 247, 250)}
    legend = {r.model_id: (r.active, r.inactive) for r in slices.slice_legend(voxels, sizes).collect()}
    assert legend == {"m": (3, 33), "empty": (0, 9)}


def test_number_rules_of_labels(spark):
    inf, nan = float("inf"), float("nan")
    kind = F.lit("finalCclComponents")
    got = [value(spark, labels.classify_label(F.lit(v), kind)) for v in (0.9, -0.5, 3.0, 7.5, -2.0, nan, inf, 1e300)]
    assert got == ["unknown", "unknown", "surface", "components", None, None, None, "components"]
    texts = [value(spark, labels.number_text(F.lit(v))) for v in (3.0, 2.25)]
    assert texts == ["3", "2.2500"]
    assert value(spark, labels.scalar_side(F.lit(nan))) == "-"


def test_short_phrases(spark):
    def phrase(text):
        return value(spark, labels.short_phrase(F.lit(text), F.lit("fallback")))

    assert phrase("  near wall : long text") == "near wall"
    assert phrase("   ") == "fallback"
    assert phrase("no colon " * 9) == ("no colon " * 9).strip()
    assert phrase(":" + "x" * 40) == ":" + "x" * 24 + "..."
    assert phrase(":short") == ":short"


def test_texts(spark):
    assert [value(spark, bytes_text(F.lit(n))) for n in (-1, 0, 1023, 1280, 1 << 20, 5 << 40)] == [
        "", "0 B", "1023 B", "1.3 KB", "1.0 MB", "5120.0 GB",
    ]
    assert value(spark, folder_label(F.lit("(selected folder)"))) == "(selected folder)"
    assert value(spark, folder_label(F.lit("host:/a/b/"))) == "host:b"
    assert value(spark, safe_file_name(F.lit("a/b c?.vxz"))) == "b_c_.vxz"
    parsed = [tuple(value(spark, parse_resolution(F.lit(t)))) for t in ("AUTO", "", "12", "1e3", "0", "-3", "x", "5d")]
    assert parsed == [(None, True), (None, True), (12, True), (1000, True), *[(None, False)] * 4]


def test_ranks(spark):
    assert [value(spark, labels.rank_deficient(F.lit(r))) for r in (0, 2, 3, 255)] == [True, True, False, None]
