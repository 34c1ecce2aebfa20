"""Surface topology, triangulation, clustering and level-of-detail meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived as d
from checks.registry import query
from voxspark.operators import lod, topology as t
from voxspark.operators.constraints import validate_faces
from voxspark.operators.ordinals import dense_ordinals, voxel_ordinals
from voxspark.operators.summary import cluster_widths, model_metadata, model_summary, resolutions
from voxspark.functions.geometry import unpack_cell, unpack_dual
from voxspark.session import settle

R = d.RESOLUTION
BUDGET = 500

EDGES = """
edges AS (
  SELECT model_id, vid, x, y, z, axis, ((flags >> (axis + 3)) & 1) = 1 AS positive
  FROM voxels, (VALUES (0), (1), (2)) AS axes(axis) WHERE (flags >> axis) & 1 = 1)"""

_STEP = {
    name: f"CASE axis WHEN 0 THEN {x} WHEN 1 THEN {y} ELSE {z} END"
    for name, (x, y, z) in {
        "1": ("1", "4096 * 4096", "4096"),
        "2": ("4096 + 1", "4096 * 4096 + 1", "4096 * 4096 + 4096"),
        "3": ("4096", "1", "4096 * 4096"),
    }.items()
}

# Cells as x * 4096^2 + y * 4096 + z: coordinates stay below 32, so a step never carries. Model and cell make one
# text key, so that no join can be planned on the model alone; the same goes for voxel and cluster keys below.
QUADS = (
    EDGES
    + f""",
cells_of AS (SELECT vid, model_id || ':' || CAST((CAST(x AS BIGINT) * 4096 + y) * 4096 + z AS VARCHAR) AS cell FROM voxels),
corner_cells AS (SELECT *, (CAST(x AS BIGINT) * 4096 + y) * 4096 + z AS cell FROM edges),
starts AS (
  SELECT model_id, vid, axis, positive, model_id || ':' || CAST(cell + {_STEP["1"]} AS VARCHAR) AS k1,
         model_id || ':' || CAST(cell + {_STEP["2"]} AS VARCHAR) AS k2,
         model_id || ':' || CAST(cell + {_STEP["3"]} AS VARCHAR) AS k3 FROM corner_cells),
loops AS (
  SELECT s.model_id, s.vid, s.axis, s.positive, n1.vid AS r1, n2.vid AS r2, n3.vid AS r3 FROM starts AS s
  JOIN cells_of AS n1 ON n1.cell = s.k1 JOIN cells_of AS n2 ON n2.cell = s.k2 JOIN cells_of AS n3 ON n3.cell = s.k3),
quads AS (
  SELECT model_id, vid, axis, positive, vid AS v0, CASE WHEN positive THEN r3 ELSE r1 END AS v1, r2 AS v2,
         CASE WHEN positive THEN r1 ELSE r3 END AS v3 FROM loops)"""
)


def _minus(a, b):
    return [f"({a}.f{c} - {b}.f{c})" for c in "xyz"]


def _cross(a, b):
    return [f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]


_FIRST = _cross(_minus("c1", "c0"), _minus("c2", "c0"))
_SECOND = _cross(_minus("c2", "c1"), _minus("c0", "c1"))
_SPLIT = f"abs(({_FIRST[0]} * {_SECOND[0]} + {_FIRST[1]} * {_SECOND[1]}) + {_FIRST[2]} * {_SECOND[2]}) > 0::FLOAT"
_PLACED = ", ".join(
    f"(CAST({c} AS FLOAT) + CAST(d{c} AS FLOAT) / 255::FLOAT) * CAST(1.0::DOUBLE / {R} AS FLOAT) - 0.5::FLOAT AS f{c}"
    for c in "xyz"
)

TRIANGLES = (
    QUADS
    + f""",
placed AS (SELECT model_id || ':' || vid AS voxel, {_PLACED} FROM voxels),
corners AS (
  SELECT *, model_id || ':' || v0 AS k0, model_id || ':' || v1 AS k1, model_id || ':' || v2 AS k2 FROM quads),
split AS (
  SELECT q.*, {_SPLIT} AS first_split FROM corners AS q
  JOIN placed AS c0 ON c0.voxel = q.k0 JOIN placed AS c1 ON c1.voxel = q.k1 JOIN placed AS c2 ON c2.voxel = q.k2),
triangles AS (
  SELECT model_id, CAST((vid * 3 + axis) * 2 AS BIGINT) AS face_key, v0 AS a, v1 AS b,
         CASE WHEN first_split THEN v2 ELSE v3 END AS c FROM split
  UNION ALL
  SELECT model_id, CAST((vid * 3 + axis) * 2 + 1 AS BIGINT), CASE WHEN first_split THEN v0 ELSE v3 END,
         CASE WHEN first_split THEN v2 ELSE v1 END, CASE WHEN first_split THEN v3 ELSE v2 END FROM split)"""
)

WIDTHS = f"""
widths AS (
  SELECT model_id, COUNT(*) AS quad_count,
         GREATEST(1, CAST(CEIL(SQRT(COUNT(*) * 2 / {BUDGET}.0::DOUBLE)) AS INT)) AS cluster_width
  FROM quads GROUP BY model_id)"""

CLUSTERS = """
keyed AS (
  SELECT v.*, w.cluster_width, ((CAST(x AS BIGINT) * 255 + dx) // (w.cluster_width * 255) << 42)
    | ((CAST(y AS BIGINT) * 255 + dy) // (w.cluster_width * 255) << 21)
    | ((CAST(z AS BIGINT) * 255 + dz) // (w.cluster_width * 255)) AS cluster
  FROM voxels AS v JOIN widths AS w ON w.model_id = v.model_id)"""

LOD = (
    TRIANGLES
    + ","
    + WIDTHS
    + ","
    + CLUSTERS
    + f""",
positions AS (
  SELECT model_id, cluster, COUNT(*) AS members,
         SUM(x * 255 + dx) / 255.0::DOUBLE / COUNT(*) / {R} - 0.5::DOUBLE AS px,
         SUM(y * 255 + dy) / 255.0::DOUBLE / COUNT(*) / {R} - 0.5::DOUBLE AS py,
         SUM(z * 255 + dz) / 255.0::DOUBLE / COUNT(*) / {R} - 0.5::DOUBLE AS pz
  FROM keyed GROUP BY model_id, cluster),
cluster_of AS (SELECT model_id || ':' || vid AS voxel, cluster FROM keyed),
coarse AS (
  SELECT t.model_id, t.face_key, ka.cluster AS a, kb.cluster AS b, kc.cluster AS c
  FROM (SELECT *, model_id || ':' || a AS ka, model_id || ':' || b AS kb, model_id || ':' || c AS kc FROM triangles) AS t
  JOIN cluster_of AS ka ON ka.voxel = t.ka JOIN cluster_of AS kb ON kb.voxel = t.kb
  JOIN cluster_of AS kc ON kc.voxel = t.kc),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (
    PARTITION BY model_id, LEAST(a, b, c), GREATEST(a, b, c), a + b + c - LEAST(a, b, c) - GREATEST(a, b, c)
    ORDER BY face_key) AS place
  FROM coarse WHERE a <> b AND b <> c AND c <> a),
lod_faces AS (SELECT model_id, face_key, a, b, c FROM ranked WHERE place = 1),
used AS (
  SELECT model_id, a AS cluster FROM lod_faces UNION SELECT model_id, b FROM lod_faces
  UNION SELECT model_id, c FROM lod_faces),
ids AS (
  SELECT model_id, cluster, CAST(ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY cluster) - 1 AS BIGINT) AS vertex_id
  FROM used)"""
)


def _grid(spark, sf, voxels=d.voxels):
    """Voxels, quads, and quad count, cluster width and resolution per model; quads are found once and read often."""
    v = settle(voxels(spark, sf))
    surface = settle(t.quads(v, with_dual=True))
    counts = surface.groupBy("model_id").agg(F.count("*").alias("quad_count"))
    return v, surface, settle(cluster_widths(counts, BUDGET).withColumn("resolution", F.lit(R)))


@query(
    "f3_signed_edges",
    "WITH " + EDGES + " SELECT model_id, vid, CAST(axis AS INT) AS axis, positive FROM edges",
    ("voxels",),
)
def f3(spark, sf):
    return t.signed_edges(d.voxels(spark, sf)).select("model_id", "vid", "axis", "positive")


@query(
    "j1_quad_topology",
    "WITH "
    + QUADS
    + """ SELECT model_id, CAST(axis AS INT) AS axis, COUNT(*) AS quads, COUNT(*) FILTER (positive) AS positive
       FROM quads GROUP BY 1, 2""",
    ("voxels",),
)
def j1(spark, sf):
    return (
        t.quads(d.voxels(spark, sf))
        .groupBy("model_id", "axis")
        .agg(F.count("*").alias("quads"), F.count_if("positive").alias("positive"))
    )


@query(
    "p14_oriented_quads",
    "WITH " + QUADS + " SELECT model_id, vid, CAST(axis AS INT) AS axis, positive, v0, v1, v2, v3 FROM quads",
    ("voxels",),
)
def p14(spark, sf):
    return t.quads(d.voxels(spark, sf)).select("model_id", "vid", "axis", "positive", *[f"v{n}" for n in t.CORNERS])


@query(
    "j2_quad_corners",
    "WITH "
    + QUADS
    + """ SELECT q.model_id, q.vid, CAST(q.axis AS INT) AS axis, c1.x AS x1, c1.y AS y1, c1.z AS z1, c1.dx AS dx1,
          c3.x AS x3, c3.y AS y3, c3.z AS z3, c3.dz AS dz3
          FROM (SELECT *, model_id || ':' || v1 AS k1, model_id || ':' || v3 AS k3 FROM quads) AS q
          JOIN (SELECT *, model_id || ':' || vid AS k FROM voxels) AS c1 ON c1.k = q.k1
          JOIN (SELECT *, model_id || ':' || vid AS k FROM voxels) AS c3 ON c3.k = q.k3""",
    ("voxels",),
)
def j2(spark, sf):
    quads = t.quads(d.voxels(spark, sf), with_dual=True)
    first, third = unpack_cell("cell1"), unpack_cell("cell3")
    return quads.select(
        "model_id",
        "vid",
        "axis",
        *[c.alias(f"{n}1") for c, n in zip(first, "xyz")],
        unpack_dual("dual1")[0].alias("dx1"),
        *[c.alias(f"{n}3") for c, n in zip(third, "xyz")],
        unpack_dual("dual3")[2].alias("dz3"),
    )


@query(
    "p15_triangles",
    "WITH " + TRIANGLES + " SELECT model_id, face_key, a, b, c FROM triangles",
    ("voxels",),
)
def p15(spark, sf):
    return t.triangles(t.quads(d.voxels(spark, sf), with_dual=True), F.lit(R))


@query(
    "w3_dense_face_ids",
    "WITH "
    + TRIANGLES
    + """ SELECT model_id, CAST(ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY face_key) - 1 AS BIGINT) AS face_id,
          a, b, c FROM triangles""",
    ("voxels",),
)
def w3(spark, sf):
    faces = t.triangles(t.quads(d.voxels(spark, sf), with_dual=True), F.lit(R))
    return dense_ordinals(faces, "face_key", "face_id").drop("face_key")


@query(
    "f7_face_rules",
    "WITH "
    + QUADS
    + """, models AS (SELECT DISTINCT model_id FROM voxels),
         counted AS (SELECT m.model_id, COUNT(q.vid) AS n FROM models AS m LEFT JOIN quads AS q ON q.model_id = m.model_id
                     GROUP BY m.model_id)
         SELECT model_id, rule, CASE WHEN rule = 'no_faces' AND n = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END
           AS violations FROM counted, (VALUES ('corner_range'), ('no_faces')) AS rules(rule)""",
    ("voxels",),
)
def f7_faces(spark, sf):
    v = d.voxels(spark, sf)
    faces = t.triangles(t.quads(v, with_dual=True), F.lit(R))
    sizes = v.groupBy("model_id").agg((F.max("vid") + 1).alias("vertex_count"))
    return validate_faces(faces, sizes)


@query(
    "a12_cluster_widths",
    "WITH " + QUADS + "," + WIDTHS + " SELECT model_id, quad_count, cluster_width FROM widths",
    ("voxels",),
)
def a12(spark, sf):
    counts = t.quads(d.voxels(spark, sf)).groupBy("model_id").agg(F.count("*").alias("quad_count"))
    return cluster_widths(counts, BUDGET)


@query(
    "a6_vertex_clusters",
    "WITH "
    + QUADS
    + ","
    + WIDTHS
    + ","
    + CLUSTERS
    + f""" SELECT model_id, cluster, COUNT(*) AS members,
           ROUND(SUM(x * 255 + dx) / 255.0::DOUBLE / COUNT(*) / {R} - 0.5::DOUBLE, 6) AS px,
           ROUND(SUM(y * 255 + dy) / 255.0::DOUBLE / COUNT(*) / {R} - 0.5::DOUBLE, 6) AS py,
           ROUND(SUM(z * 255 + dz) / 255.0::DOUBLE / COUNT(*) / {R} - 0.5::DOUBLE, 6) AS pz
           FROM keyed GROUP BY model_id, cluster""",
    ("voxels",),
)
def a6(spark, sf):
    v, _, grid = _grid(spark, sf)
    clusters = lod.cluster_vertices(v, grid)
    return clusters.select("model_id", "cluster", "members", *[F.round(c, 6).alias(f"p{c}") for c in "xyz"])


@query(
    "w2_cluster_ids",
    "WITH "
    + QUADS
    + ","
    + WIDTHS
    + ","
    + CLUSTERS
    + """ SELECT model_id, cluster,
          CAST(ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY cluster) - 1 AS BIGINT) AS cluster_id
          FROM (SELECT DISTINCT model_id, cluster FROM keyed) AS k""",
    ("voxels",),
)
def w2(spark, sf):
    v, _, grid = _grid(spark, sf)
    keys = settle(lod.cluster_vertices(v, grid).select("model_id", "cluster"))
    return dense_ordinals(keys, "cluster", "cluster_id")


@query(
    "j3_clustered_triangles",
    "WITH "
    + LOD
    + " SELECT model_id, COUNT(*) AS triangles, COUNT(*) FILTER (a <> b AND b <> c AND c <> a) AS kept "
    + "FROM coarse GROUP BY model_id",
    ("voxels",),
)
def j3(spark, sf):
    v, surface, grid = _grid(spark, sf)
    quads = lod.lookup_join(surface, grid.select(*lod.GRID), ["model_id"])
    keys = [
        lod.cluster_key(unpack_cell(f"cell{n}"), unpack_dual(f"dual{n}")).alias(f"cluster{n}") for n in t.CORNERS
    ]
    coarse = t.triangles(quads.select("*", *keys), "resolution", "cluster")
    return coarse.groupBy("model_id").agg(
        F.count("*").alias("triangles"), F.count_if(F.expr("a <> b AND b <> c AND c <> a")).alias("kept")
    )


@query("d1_distinct_triangles", "WITH " + LOD + " SELECT model_id, face_key, a, b, c FROM lod_faces", ("voxels",))
def d1(spark, sf):
    v, surface, grid = _grid(spark, sf)
    return lod.lod_faces(surface, grid)


# Steps of the larger grid, and sums of keys that leave 64 bits.
FAR = "WITH voxels AS (SELECT * FROM far_voxels)," + LOD.replace("4096 * 4096", "4398046511104").replace("4096", "2097152").replace("a + b + c", "a::HUGEINT + b + c")


@query(
    "p14_far_quads",
    FAR + " SELECT model_id, vid, CAST(axis AS INT) AS axis, positive, v0, v1, v2, v3 FROM quads",
    ("far_voxels",),
)
def p14_far(spark, sf):
    return t.quads(d.far_voxels(spark, sf)).select("model_id", "vid", "axis", "positive", *[f"v{n}" for n in t.CORNERS])


@query("d1_far_triangles", FAR + " SELECT model_id, face_key, a, b, c FROM lod_faces", ("far_voxels",))
def d1_far(spark, sf):
    v, surface, grid = _grid(spark, sf, d.far_voxels)
    return lod.lod_faces(surface, grid)


@query(
    "w4_far_faces",
    FAR
    + """ SELECT f.model_id, f.face_key, ia.vertex_id AS a, ib.vertex_id AS b, ic.vertex_id AS c FROM lod_faces AS f
          JOIN ids AS ia ON ia.model_id = f.model_id AND ia.cluster = f.a JOIN ids AS ib ON ib.model_id = f.model_id AND ib.cluster = f.b
          JOIN ids AS ic ON ic.model_id = f.model_id AND ic.cluster = f.c""",
    ("far_voxels",),
)
def w4_far(spark, sf):
    v, surface, grid = _grid(spark, sf, d.far_voxels)
    return lod.reindex(lod.lod_faces(surface, grid))[1]


@query("f5_non_degenerate", "WITH " + LOD + " SELECT model_id, face_key, a, b, c FROM ranked", ("voxels",))
def f5(spark, sf):
    v, surface, grid = _grid(spark, sf)
    quads = lod.lookup_join(surface, grid.select(*lod.GRID), ["model_id"])
    keys = [
        lod.cluster_key(unpack_cell(f"cell{n}"), unpack_dual(f"dual{n}")).alias(f"cluster{n}") for n in t.CORNERS
    ]
    return t.non_degenerate(t.triangles(quads.select("*", *keys), "resolution", "cluster"))


@query("d2_used_vertices", "WITH " + LOD + " SELECT model_id, cluster AS vertex FROM used", ("voxels",))
def d2(spark, sf):
    v, surface, grid = _grid(spark, sf)
    return lod.used_vertices(lod.lod_faces(surface, grid))


@query(
    "w4_reindexed_faces",
    "WITH "
    + LOD
    + """, keyed_ids AS (SELECT model_id || ':' || cluster AS k, vertex_id FROM ids)
          SELECT f.model_id, f.face_key, ia.vertex_id AS a, ib.vertex_id AS b, ic.vertex_id AS c
          FROM (SELECT *, model_id || ':' || a AS ka, model_id || ':' || b AS kb, model_id || ':' || c AS kc
                FROM lod_faces) AS f
          JOIN keyed_ids AS ia ON ia.k = f.ka JOIN keyed_ids AS ib ON ib.k = f.kb JOIN keyed_ids AS ic ON ic.k = f.kc""",
    ("voxels",),
)
def w4(spark, sf):
    v, surface, grid = _grid(spark, sf)
    return lod.lod_mesh(v, grid, surface)[1]


@query(
    "a16_lod_vertices",
    "WITH "
    + LOD
    + """ SELECT i.model_id, i.vertex_id, ROUND(CAST(CAST(p.px AS FLOAT) AS DOUBLE), 6) AS px,
          ROUND(CAST(CAST(p.py AS FLOAT) AS DOUBLE), 6) AS py, ROUND(CAST(CAST(p.pz AS FLOAT) AS DOUBLE), 6) AS pz
          FROM ids AS i JOIN positions AS p ON p.model_id = i.model_id AND p.cluster = i.cluster""",
    ("voxels",),
)
def a16(spark, sf):
    v, surface, grid = _grid(spark, sf)
    vertices = lod.lod_mesh(v, grid, surface)[0]
    return vertices.select(
        "model_id", "vertex_id", *[F.round(F.col(c).cast("double"), 6).alias(f"p{c}") for c in "xyz"]
    )


@query(
    "w1_voxel_ordinals",
    """WITH starts AS (
         SELECT model_id, chunk_no, SUM(n) OVER (PARTITION BY model_id ORDER BY chunk_no) - n AS start
         FROM (SELECT model_id, chunk_no, COUNT(*) AS n FROM chunked GROUP BY 1, 2) AS c)
       SELECT c.model_id, c.x, c.y, c.z, CAST(s.start + c.chunk_rank AS BIGINT) AS ordinal
       FROM chunked AS c JOIN starts AS s ON s.model_id = c.model_id AND s.chunk_no = c.chunk_no""",
    ("chunked",),
)
def w1(spark, sf):
    chunked = d.spark_sql(spark, sf, d.CHUNKED).drop("vid")
    return voxel_ordinals(chunked, "ordinal").select("model_id", "x", "y", "z", "ordinal")


@query(
    "a1_model_metadata",
    "WITH "
    + LOD
    + f""", counted AS (
          SELECT model_id, COUNT(*) AS voxel_count, COUNT(ovoxel_type) > 0 AS has_ovoxel_type,
            COUNT(qef_rank) > 0 AS has_qef_rank, COUNT(*) FILTER (ovoxel_type = 2) AS type_2,
            COUNT(*) FILTER (qef_rank = 3) AS rank_3, MIN(x) AS min_x, MAX(z) AS max_z,
            ROUND(MIN((x + dx / 255.0::DOUBLE) / {R} - 0.5::DOUBLE), 6) AS bounds_min_x,
            ROUND(MAX((z + dz / 255.0::DOUBLE) / {R} - 0.5::DOUBLE), 6) AS bounds_max_z FROM voxels GROUP BY model_id)
        SELECT c.*, CAST({R} AS INT) AS resolution, w.quad_count, w.quad_count * 2 AS face_count, w.cluster_width,
          CAST((c.voxel_count + (c.voxel_count + 999) // 1000 - 1) // ((c.voxel_count + 999) // 1000) AS BIGINT)
            AS preview_voxel_count,
          (SELECT COUNT(*) FROM ids AS i WHERE i.model_id = c.model_id) AS preview_vertex_count,
          (SELECT COUNT(*) FROM lod_faces AS f WHERE f.model_id = c.model_id) AS preview_face_count,
          3 AS format_version, 5 AS store_version
        FROM counted AS c JOIN widths AS w ON w.model_id = c.model_id""",
    ("voxels",),
)
def a1(spark, sf):
    v, surface, grid = _grid(spark, sf)
    summary = model_summary(v, grid)
    widths = grid.select("model_id", "quad_count", "cluster_width")
    # The counts need neither positions nor new ids: one vertex per used cluster, one face per coarse face.
    faces = settle(lod.lod_faces(surface, grid))
    metadata = model_metadata(summary, widths, lod.used_vertices(faces), faces, point_budget=1000)
    return metadata.select(
        "model_id",
        "voxel_count",
        "has_ovoxel_type",
        "has_qef_rank",
        F.col("ovoxel_type_counts")[2].alias("type_2"),
        F.col("qef_rank_counts")[3].alias("rank_3"),
        F.col("grid_min")[0].alias("min_x"),
        F.col("grid_max")[2].alias("max_z"),
        F.round(F.col("bounds_min")[0].cast("double"), 6).alias("bounds_min_x"),
        F.round(F.col("bounds_max")[2].cast("double"), 6).alias("bounds_max_z"),
        "resolution",
        "quad_count",
        "face_count",
        "cluster_width",
        F.col("preview_voxel_count").cast("long").alias("preview_voxel_count"),
        "preview_vertex_count",
        "preview_face_count",
        "format_version",
        "store_version",
    )


@query(
    "a11_resolutions",
    """SELECT model_id, CASE WHEN model_id LIKE 'N%' THEN 64 ELSE GREATEST(MAX(x), MAX(y), MAX(z)) + 1 END AS resolution,
       CASE WHEN model_id LIKE 'N%' THEN 'explicit' ELSE 'inferred' END AS resolution_source,
       GREATEST(MAX(x), MAX(y), MAX(z)) AS max_coord, COUNT(*) AS voxel_count FROM voxels GROUP BY model_id""",
    ("voxels",),
)
def a11(spark, sf):
    v = d.voxels(spark, sf)
    requested = v.where("model_id LIKE 'N%'").select("model_id").distinct().withColumn("resolution", F.lit(64))
    return resolutions(v, requested)
