"""Level-of-detail meshes by clustering dual vertices on a coarse grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.functions.geometry import cluster_coord, pack_cell, unpack_cell, unpack_dual
from voxspark.operators.lookup import lookup_join
from voxspark.operators.ordinals import dense_ordinals
from voxspark.operators.topology import CORNERS, distinct_triangles, non_degenerate, quads, triangles
from voxspark.session import settle

GRID = ("model_id", "resolution", "cluster_width")


def cluster_key(coords, duals, width="cluster_width") -> Column:
    return pack_cell(*[cluster_coord(c, d, width) for c, d in zip(coords, duals)])


def cluster_vertices(voxels: DataFrame, grid: DataFrame) -> DataFrame:
    """Mean position of every cluster: model_id, cluster, x, y, z, members.

    ``grid`` has model_id, resolution and cluster_width. Sums are whole 1/255 cells, so they are exact and do not
    depend on the order of rows.
    """
    sized = lookup_join(voxels, grid.select(*GRID), ["model_id"])
    keyed = sized.withColumn("cluster", cluster_key("xyz", ["dx", "dy", "dz"]))
    sums = keyed.groupBy("model_id", "cluster").agg(
        F.max("resolution").alias("resolution"),
        F.count("*").alias("members"),
        *[F.sum(F.col(c).cast("long") * 255 + F.col(f"d{c}")).alias(f"__{c}") for c in "xyz"],
    )
    return sums.select(
        "model_id",
        "cluster",
        *[(F.col(f"__{c}") / 255.0 / F.col("members") / F.col("resolution") - 0.5).alias(c) for c in "xyz"],
        "members",
    )


def lod_faces(quad_table: DataFrame, grid: DataFrame) -> DataFrame:
    """Distinct non-degenerate triangles between clusters: model_id, face_key, a, b, c as cluster keys.

    A cluster is a function of its voxel, so corners are mapped by projection and no join is needed.
    """
    sized = lookup_join(quad_table, grid.select(*GRID), ["model_id"])
    clustered = sized.select(
        "*",
        *[cluster_key(unpack_cell(f"cell{n}"), unpack_dual(f"dual{n}")).alias(f"cluster{n}") for n in CORNERS],
    )
    return distinct_triangles(non_degenerate(triangles(clustered, "resolution", "cluster")))


def used_vertices(faces: DataFrame) -> DataFrame:
    """Every vertex key that a triangle uses, once."""
    return faces.select("model_id", F.explode(F.array("a", "b", "c")).alias("vertex")).distinct()


def reindex(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertex ids, faces): dense ids in key order for used vertices, and faces that refer to them."""
    ids = settle(dense_ordinals(used_vertices(faces), "vertex", "vertex_id"))
    renamed = faces
    for corner in "abc":
        mapped = ids.select("model_id", F.col("vertex").alias(corner), F.col("vertex_id").alias(f"__{corner}"))
        renamed = renamed.join(mapped, ["model_id", corner])
    return ids, renamed.select("model_id", "face_key", *[F.col(f"__{corner}").alias(corner) for corner in "abc"])


def lod_mesh(voxels: DataFrame, grid: DataFrame, quad_table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of the clustered mesh of every model; vertices that no face uses are left out.

    The coarse faces are read five times (once for ids, three times for corners, once for output), so they are settled.
    """
    quad_table = quads(voxels, with_dual=True) if quad_table is None else quad_table
    ids, faces = reindex(settle(lod_faces(quad_table, grid)))
    positions = cluster_vertices(voxels, grid)
    vertices = ids.join(positions, [ids.model_id == positions.model_id, ids.vertex == positions.cluster]).select(
        ids.model_id, "vertex_id", *[F.col(c).cast("float").alias(c) for c in "xyz"]
    )
    return vertices, faces
