"""Mesh bounds, normalisation, normals and clipping."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived as d
from checks.registry import query
from checks.topology import TRIANGLES
from voxspark.operators import meshes as m
from voxspark.operators import topology as t

R = d.RESOLUTION
CUT = 0.01

BOUNDS = """
bounds AS (
  SELECT mesh_id, MIN(x) AS min_x, MIN(y) AS min_y, MIN(z) AS min_z, MAX(x) AS max_x, MAX(y) AS max_y, MAX(z) AS max_z
  FROM vertices GROUP BY mesh_id)"""

TARGETS = """
preferred AS (SELECT mesh_id, min_x + 1 AS min_x, min_y AS min_y, min_z - 2 AS min_z, max_x + 3 AS max_x, max_y AS max_y,
              max_z AS max_z FROM bounds WHERE mesh_id % 3 = 0),
fallback AS (SELECT mesh_id, -1.0::DOUBLE AS min_x, -2.0::DOUBLE AS min_y, -3.0::DOUBLE AS min_z, 1.0::DOUBLE AS max_x,
             2.0::DOUBLE AS max_y, 3.0::DOUBLE AS max_z FROM bounds WHERE mesh_id % 3 < 2),
targets AS (
  SELECT b.mesh_id, COALESCE(p.min_x, f.min_x) AS min_x, COALESCE(p.min_y, f.min_y) AS min_y,
         COALESCE(p.min_z, f.min_z) AS min_z, COALESCE(p.max_x, f.max_x) AS max_x, COALESCE(p.max_y, f.max_y) AS max_y,
         COALESCE(p.max_z, f.max_z) AS max_z
  FROM bounds AS b LEFT JOIN preferred AS p ON p.mesh_id = b.mesh_id LEFT JOIN fallback AS f ON f.mesh_id = b.mesh_id
  WHERE COALESCE(p.min_x, f.min_x) IS NOT NULL)"""

SURFACE = (
    TRIANGLES
    + f""",
points AS (SELECT model_id || ':' || vid AS k, (x + dx / 255.0::DOUBLE) / {R} - 0.5::DOUBLE AS px,
           (y + dy / 255.0::DOUBLE) / {R} - 0.5::DOUBLE AS py, (z + dz / 255.0::DOUBLE) / {R} - 0.5::DOUBLE AS pz FROM voxels),
placed_faces AS (
  SELECT t.model_id AS mesh_id, t.face_key AS face_id, t.a, t.b, t.c, pa.px AS ax, pa.py AS ay, pa.pz AS az,
         pb.px AS hx, pb.py AS hy, pb.pz AS hz, pc.px AS cx, pc.py AS cy, pc.pz AS cz
  FROM (SELECT *, model_id || ':' || a AS ka, model_id || ':' || b AS kb, model_id || ':' || c AS kc FROM triangles) AS t
  JOIN points AS pa ON pa.k = t.ka JOIN points AS pb ON pb.k = t.kb JOIN points AS pc ON pc.k = t.kc)"""
)


def _targets(vertices):
    bounds = m.mesh_bounds(vertices)
    preferred = bounds.where("mesh_id % 3 = 0").selectExpr(
        "mesh_id", "min_x + 1 AS min_x", "min_y", "min_z - 2 AS min_z", "max_x + 3 AS max_x", "max_y", "max_z"
    )
    fallback = bounds.where("mesh_id % 3 < 2").selectExpr(
        "mesh_id",
        *[f"CAST({v} AS DOUBLE) AS {n}" for v, n in zip((-1, -2, -3, 1, 2, 3), m.BOUNDS)],
    )
    return m.target_bounds(bounds.select("mesh_id"), preferred, fallback)


def _surface(spark, sf):
    """All faces with the positions of their corners, as the quads carry them."""
    faces = t.placed_triangles(t.quads(d.voxels(spark, sf), with_dual=True), F.lit(R))
    return faces.withColumnsRenamed({"model_id": "mesh_id", "face_key": "face_id"})


@query(
    "a10_mesh_bounds",
    f"""WITH {BOUNDS} SELECT *, ROUND((min_x + max_x) / 2, 6) AS center_x, ROUND((min_y + max_y) / 2, 6) AS center_y,
        ROUND((min_z + max_z) / 2, 6) AS center_z,
        ROUND(GREATEST(max_x - min_x, max_y - min_y, max_z - min_z), 6) AS longest_edge FROM bounds""",
    ("vertices",),
)
def a10(spark, sf):
    bounds = m.mesh_bounds(d.vertices(spark, sf))
    derived = [F.round(c, 6).alias(c) for c in ("center_x", "center_y", "center_z", "longest_edge")]
    return bounds.select("mesh_id", *m.BOUNDS, *derived)


@query("j8_target_bounds", f"WITH {BOUNDS}, {TARGETS} SELECT * FROM targets", ("vertices",))
def j8(spark, sf):
    return _targets(d.vertices(spark, sf))


@query(
    "p16_normalized_meshes",
    f"""WITH {BOUNDS}, {TARGETS}, moves AS (
          SELECT b.mesh_id, t.mesh_id IS NOT NULL AS normalized,
            GREATEST(t.max_x - t.min_x, t.max_y - t.min_y, t.max_z - t.min_z)
              / GREATEST(b.max_x - b.min_x, b.max_y - b.min_y, b.max_z - b.min_z) AS s,
            (b.min_x + b.max_x) / 2 AS fx, (b.min_y + b.max_y) / 2 AS fy, (b.min_z + b.max_z) / 2 AS fz,
            (t.min_x + t.max_x) / 2 AS tx, (t.min_y + t.max_y) / 2 AS ty, (t.min_z + t.max_z) / 2 AS tz
          FROM bounds AS b LEFT JOIN targets AS t ON t.mesh_id = b.mesh_id)
        SELECT v.mesh_id, v.vertex_id, ROUND(CASE WHEN normalized THEN (x - fx) * s + tx ELSE x END, 6) AS x,
          ROUND(CASE WHEN normalized THEN (y - fy) * s + ty ELSE y END, 6) AS y,
          ROUND(CASE WHEN normalized THEN (z - fz) * s + tz ELSE z END, 6) AS z, normalized
        FROM vertices AS v JOIN moves AS w ON w.mesh_id = v.mesh_id""",
    ("vertices",),
)
def p16(spark, sf):
    vertices = d.vertices(spark, sf)
    moved = m.normalize_to_bounds(vertices, _targets(vertices))
    return moved.select("mesh_id", "vertex_id", *[F.round(c, 6).alias(c) for c in "xyz"], "normalized")


@query(
    "f4_clipped_points",
    f"SELECT mesh_id, vertex_id, x, y, z FROM vertices WHERE y <= {CUT}",
    ("vertices",),
)
def f4(spark, sf):
    return m.clip_points(d.vertices(spark, sf), "y", CUT)


@query(
    "f4_clipped_faces",
    f"""WITH {SURFACE} SELECT mesh_id, face_id, CASE WHEN GREATEST(ax, hx, cx) <= -0.25 THEN 'kept'
        WHEN LEAST(ax, hx, cx) > -0.25 THEN 'dropped' ELSE 'cut' END AS clip FROM placed_faces""",
    ("voxels",),
)
def f4_faces(spark, sf):
    return m.classify_placed_faces(_surface(spark, sf), "x", -0.25).select("mesh_id", "face_id", "clip")


@query(
    "a15_vertex_normals",
    f"""WITH {SURFACE}, crossed AS (
          SELECT mesh_id, a, b, c, (cy - hy) * (az - hz) - (cz - hz) * (ay - hy) AS nx,
            (cz - hz) * (ax - hx) - (cx - hx) * (az - hz) AS ny, (cx - hx) * (ay - hy) - (cy - hy) * (ax - hx) AS nz
          FROM placed_faces),
        corner AS (SELECT mesh_id, a AS vertex_id, nx, ny, nz FROM crossed UNION ALL
                   SELECT mesh_id, b, nx, ny, nz FROM crossed UNION ALL SELECT mesh_id, c, nx, ny, nz FROM crossed),
        summed AS (SELECT mesh_id, vertex_id, SUM(nx) AS nx, SUM(ny) AS ny, SUM(nz) AS nz FROM corner GROUP BY 1, 2)
        SELECT mesh_id, vertex_id, ROUND(nx / sqrt(nx * nx + ny * ny + nz * nz), 4) + 0.0::DOUBLE AS nx,
          ROUND(ny / sqrt(nx * nx + ny * ny + nz * nz), 4) + 0.0::DOUBLE AS ny,
          ROUND(nz / sqrt(nx * nx + ny * ny + nz * nz), 4) + 0.0::DOUBLE AS nz
        FROM summed WHERE sqrt(nx * nx + ny * ny + nz * nz) > 1e-9""",
    ("voxels",),
)
def a15(spark, sf):
    # Sums of doubles depend on the order of rows, so both sides leave out vertices whose normals cancel.
    normals = m.placed_normal_sums(_surface(spark, sf)).where("sqrt(nx * nx + ny * ny + nz * nz) > 1e-9")
    return m.unit_normals(normals).select(
        "mesh_id", "vertex_id", *[(F.round(n, 4) + F.lit(0.0)).alias(n) for n in ("nx", "ny", "nz")]
    )
