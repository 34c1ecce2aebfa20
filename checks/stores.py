"""Round trips through sinks, stores and streams, on the whole derived tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import derived as d
from checks.registry import CTES, query
from checks.files import _written
from checks.topology import BUDGET, LOD, QUADS, TRIANGLES, WIDTHS
from voxspark.functions.geometry import dual_position_f32
from voxspark.operators import topology as t
from voxspark.operators.ordinals import dense_ordinals
from voxspark.plans.prepare import prepare, stored_slice
from voxspark.plans.store import store_table
from voxspark.session import checkpoint_dir
from voxspark.sinks.ply import write_ply
from voxspark.sources import register
from voxspark.sources.vxz import corpus_files
from voxspark.streaming.progress import follow_progress, progress_of

R = d.RESOLUTION


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/voxspark-{uuid.uuid4().hex}"


def _written_meshes(spark, sf) -> str:
    """Exact meshes of all models, written as PLY files."""
    register(spark)
    voxels = dense_ordinals(d.voxels(spark, sf).drop("vid").withColumn("key", F.expr("(x * 16 + y) * 32 + z").cast("long")), "key", "vid")
    vertices = voxels.select(
        F.col("model_id").alias("mesh_id"),
        F.col("vid").alias("vertex_id"),
        *[dual_position_f32(c, f"d{c}", R).alias(c) for c in "xyz"],
    )
    keyed = t.triangles(t.quads(voxels, with_dual=True), F.lit(R))
    faces = dense_ordinals(keyed, "face_key", "face_id").withColumnRenamed("model_id", "mesh_id")
    meshes = voxels.select(F.col("model_id").alias("mesh_id")).distinct()
    meshes = meshes.select("mesh_id", F.concat("mesh_id", F.lit(".vxz")).alias("source"), F.lit(R).alias("resolution"))
    folder = _folder(spark)
    write_ply(meshes, vertices, faces, folder)
    return folder


DENSE = TRIANGLES.replace("FROM voxels", "FROM dense").replace("JOIN voxels", "JOIN dense")
NUMBERED = """dense AS (
  SELECT v.* EXCLUDE (vid), CAST(ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY vid) - 1 AS BIGINT) AS vid
  FROM voxels AS v)"""


@query(
    "k2_ply_faces",
    f"""WITH {NUMBERED}, {DENSE} SELECT model_id || '.ply' AS mesh_id,
        CAST(ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY face_key) - 1 AS BIGINT) AS face_id, a, b, c FROM triangles""",
    ("voxels",),
)
def k2_faces(spark, sf):
    return spark.read.format("mesh").option("content", "faces").load(_written_meshes(spark, sf))


@query(
    "k2_ply_vertices",
    f"""WITH {NUMBERED} SELECT model_id || '.ply' AS mesh_id, vid AS vertex_id,
        (CAST(x AS FLOAT) + CAST(dx AS FLOAT) / 255::FLOAT) / {R}::FLOAT - 0.5::FLOAT AS x,
        (CAST(y AS FLOAT) + CAST(dy AS FLOAT) / 255::FLOAT) / {R}::FLOAT - 0.5::FLOAT AS y,
        (CAST(z AS FLOAT) + CAST(dz AS FLOAT) / 255::FLOAT) / {R}::FLOAT - 0.5::FLOAT AS z FROM dense""",
    ("voxels",),
)
def k2_vertices(spark, sf):
    return spark.read.format("mesh").load(_written_meshes(spark, sf))


def _prepared(spark, sf) -> str:
    """A store of all models, prepared from files that tasks write."""
    store = _folder(spark)
    prepare(corpus_files(spark, _written(spark, sf, False)), store, face_budget=BUDGET)
    return store


@query(
    "k1_stored_slice",
    """SELECT model_id, x, y, z, dx, dy, dz, flags, ovoxel_type, qef_rank FROM voxels WHERE model_id = 'N0' AND y = 5""",
    ("voxels",),
)
def k1(spark, sf):
    found = stored_slice(spark, _prepared(spark, sf), "N0", "y", 5)
    return found.select("model_id", "x", "y", "z", "dx", "dy", "dz", "flags", "ovoxel_type", "qef_rank")


@query(
    "k3_metadata",
    "WITH "
    + QUADS
    + ","
    + WIDTHS
    + """ SELECT w.model_id, n AS voxel_count, CAST(2 * quad_count AS BIGINT) AS face_count, cluster_width, w.model_id || '.vxz' AS source_name
          FROM widths AS w JOIN (SELECT model_id, COUNT(*) AS n FROM voxels GROUP BY model_id) AS v ON v.model_id = w.model_id""",
    ("voxels",),
)
def k3(spark, sf):
    metadata = store_table(spark, _prepared(spark, sf), "metadata")
    return metadata.select("model_id", F.col("voxel_count").cast("long"), F.col("face_count").cast("long"), "cluster_width", "source_name")


# Which of several equal triangles is kept depends on the order of voxels in files, so corners are compared sorted.
@query(
    "k4_lod",
    "WITH "
    + LOD
    + """ SELECT f.model_id, LEAST(ia.vertex_id, ib.vertex_id, ic.vertex_id) AS low, GREATEST(ia.vertex_id, ib.vertex_id, ic.vertex_id) AS high,
            ia.vertex_id + ib.vertex_id + ic.vertex_id AS total FROM lod_faces AS f
          JOIN ids AS ia ON ia.model_id = f.model_id AND ia.cluster = f.a JOIN ids AS ib ON ib.model_id = f.model_id AND ib.cluster = f.b
          JOIN ids AS ic ON ic.model_id = f.model_id AND ic.cluster = f.c""",
    ("voxels",),
)
def k4(spark, sf):
    faces = store_table(spark, _prepared(spark, sf), "lod_faces")
    return faces.select("model_id", F.least("a", "b", "c").alias("low"), F.greatest("a", "b", "c").alias("high"), (F.col("a") + F.col("b") + F.col("c")).alias("total"))


@query(
    "t2_progress_stream",
    """WITH parsed AS (
         SELECT job, line_no, regexp_extract(line, '"stage":"([a-z]+)"', 1) AS stage,
                CAST(regexp_extract(line, '"fraction":([0-9]+)', 1) AS DOUBLE) AS fraction
         FROM progress_lines WHERE line LIKE 'PROGRESS {"stage"%')
       SELECT job, max_by(stage, line_no) AS stage, max_by(fraction, line_no) AS progress, CAST(NULL AS VARCHAR) AS message
       FROM parsed GROUP BY job""",
    ("progress_lines",),
)
def t2(spark, sf):
    schema = d.spark_table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    lines = spark.sql(CTES["progress_lines"], events=events)
    saved = _folder(spark)
    follow_progress(lines, saved, _folder(spark), available_now=True).awaitTermination()
    return progress_of(spark, saved)
