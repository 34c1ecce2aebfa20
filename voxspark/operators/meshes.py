"""Bounds, normalisation, normals and clipping of triangle meshes."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.constants import MIN_NORMALIZABLE_EDGE
from voxspark.functions.geometry import check_axis
from voxspark.functions.labels import is_finite
from voxspark.operators.lookup import lookup_join
from voxspark.session import settle

BOUNDS = ("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")


def mesh_bounds(vertices: DataFrame, group: str = "mesh_id") -> DataFrame:
    """Axis-aligned bounds, centre and longest edge per mesh."""
    boxed = vertices.groupBy(group).agg(
        *[f(F.col(c).cast("double")).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    )
    return boxed.withColumns(
        {
            **{f"center_{c}": (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in "xyz"},
            "longest_edge": F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"]),
        }
    )


def target_bounds(meshes: DataFrame, preferred: DataFrame, fallback: DataFrame) -> DataFrame:
    """Per mesh_id: the preferred box if there is one, else the fallback box; boxes carry the six bounds."""

    def box(table: DataFrame, name: str) -> DataFrame:
        usable = F.col("min_x") <= F.col("max_x")
        return table.where(usable).select("mesh_id", F.struct(*BOUNDS).alias(name))

    joined = meshes.join(box(preferred, "__first"), "mesh_id", "left").join(box(fallback, "__second"), "mesh_id", "left")
    chosen = F.coalesce("__first", "__second")
    return joined.where(chosen.isNotNull()).select("mesh_id", *[chosen[b].alias(b) for b in BOUNDS])


def normalize_to_bounds(vertices: DataFrame, targets: DataFrame) -> DataFrame:
    """Scale every mesh uniformly so its longest edge matches its target box, and centre it there.

    A mesh without a usable source or target box keeps its vertices; ``normalized`` tells which happened.
    """
    source = mesh_bounds(vertices)
    target = targets.select(
        "mesh_id",
        F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"]).alias("__edge"),
        *[((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(f"__to_{c}") for c in "xyz"],
    )
    usable = F.lit(True)
    for edge in ("longest_edge", "__edge"):
        usable = usable & F.coalesce(is_finite(edge) & (F.col(edge) > MIN_NORMALIZABLE_EDGE), F.lit(False))
    moves = source.join(target, "mesh_id", "left").select(
        "mesh_id",
        usable.alias("normalized"),
        F.when(usable, F.col("__edge") / F.col("longest_edge")).alias("__scale"),
        *[F.col(f"center_{c}").alias(f"__from_{c}") for c in "xyz"],
        *[F.col(f"__to_{c}") for c in "xyz"],
    )

    def moved(c: str) -> Column:
        fitted = (F.col(c) - F.col(f"__from_{c}")) * F.col("__scale") + F.col(f"__to_{c}")
        return F.when(F.col("normalized"), fitted).otherwise(F.col(c)).alias(c)

    return lookup_join(vertices, settle(moves), ["mesh_id"]).select(
        "mesh_id", "vertex_id", *[moved(c) for c in "xyz"], "normalized"
    )


def placed_faces(faces: DataFrame, vertices: DataFrame, how: str = "inner") -> DataFrame:
    """Faces with the position of every corner as structs pa, pb and pc, looked up among the vertices.

    Every corner shuffles the faces once. Faces of voxel models need none of it: ``topology.placed_triangles``.
    """
    placed = faces
    for corner in "abc":
        corner_vertex = vertices.select(
            "mesh_id", F.col("vertex_id").alias(corner), F.struct(*[F.col(c).cast("double").alias(c) for c in "xyz"]).alias(f"p{corner}")
        )
        placed = placed.join(corner_vertex, ["mesh_id", corner], how)
    return placed


def vertex_normal_sums(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Sum of the area-weighted face normals around every vertex that a face uses.

    A face with a corner that is no vertex has no normal and adds nothing; ``classify_faces`` names such faces.
    """
    return placed_normal_sums(placed_faces(faces, vertices))


def placed_normal_sums(placed: DataFrame) -> DataFrame:
    """``vertex_normal_sums`` of faces that carry the positions of their corners."""

    def edge(to: str, c: str) -> Column:
        return F.col(f"p{to}")[c] - F.col("pb")[c]

    def normal(c: str, d: str) -> Column:
        return edge("c", c) * edge("a", d) - edge("c", d) * edge("a", c)

    weighted = placed.select(
        "mesh_id",
        F.explode(F.array("a", "b", "c")).alias("vertex_id"),
        normal("y", "z").alias("nx"),
        normal("z", "x").alias("ny"),
        normal("x", "y").alias("nz"),
    )
    return weighted.groupBy("mesh_id", "vertex_id").agg(*[F.sum(n).alias(n) for n in ("nx", "ny", "nz")])


def unit_normals(sums: DataFrame) -> DataFrame:
    """Normals of length one; zero where the faces cancel."""
    length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return sums.select(
        "mesh_id",
        "vertex_id",
        *[F.when(length > 0, F.col(n) / length).otherwise(F.lit(0.0)).alias(n) for n in ("nx", "ny", "nz")],
    )


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Unit normals per vertex, faces weighted by area."""
    return unit_normals(vertex_normal_sums(faces, vertices))


def clip_points(points: DataFrame, axis: str, position: float) -> DataFrame:
    """Points at or below the slice plane."""
    return points.where(F.col(check_axis(axis)) <= position)


def classify_faces(faces: DataFrame, vertices: DataFrame, axis: str, position: float) -> DataFrame:
    """Adds ``clip``: kept (all corners at or below the plane), dropped (all above), cut, or unknown (a corner is no vertex)."""
    return classify_placed_faces(placed_faces(faces, vertices, "left"), axis, position)


def classify_placed_faces(placed: DataFrame, axis: str, position: float) -> DataFrame:
    """``classify_faces`` of faces that carry the positions of their corners."""
    values = [F.col(f"p{corner}")[check_axis(axis)] for corner in "abc"]
    unknown = functools.reduce(operator.or_, [F.col(f"p{corner}").isNull() for corner in "abc"])
    clip = (
        F.when(unknown, "unknown").when(F.greatest(*values) <= position, "kept").when(F.least(*values) > position, "dropped").otherwise("cut")
    )
    return placed.select("mesh_id", "face_id", "a", "b", "c", clip.alias("clip"))
