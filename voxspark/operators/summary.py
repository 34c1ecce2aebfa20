"""One row per model: resolution, histograms, bounds and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.constants import FORMAT_VERSION, MAX_ATTRIBUTE_CASE, MESH_FACE_BUDGET, POINT_BUDGET, STORE_VERSION
from voxspark.functions.geometry import dual_position_f32
from voxspark.operators.lookup import lookup_join
from voxspark.session import settle


def resolutions(voxels: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """model_id, resolution, resolution_source, max_coord: the requested resolution, or the largest coordinate + 1."""
    top = voxels.groupBy("model_id").agg(
        F.greatest(F.max("x"), F.max("y"), F.max("z")).alias("max_coord"), F.count("*").alias("voxel_count")
    )
    if requested is None:
        wanted = F.lit(None).cast("int")
    else:
        top = top.join(requested.select("model_id", F.col("resolution").alias("__wanted")), "model_id", "left")
        wanted = F.col("__wanted")
    return top.select(
        "model_id",
        F.coalesce(wanted, F.col("max_coord") + 1).cast("int").alias("resolution"),
        F.when(wanted.isNull(), "inferred").otherwise("explicit").alias("resolution_source"),
        "max_coord",
        "voxel_count",
    )


def case_counts(column: str) -> Column:
    """Counts of the cases 0..3 of an attribute, zeros kept, NULL never counted."""
    return F.array(*[F.count_if(F.col(column) == case) for case in range(MAX_ATTRIBUTE_CASE + 1)])


def cluster_widths(quad_counts: DataFrame, face_budget: int = MESH_FACE_BUDGET) -> DataFrame:
    """Adds cluster_width: cells per cluster that bring 2 * quad_count faces near the budget."""
    if face_budget <= 0:
        raise ValueError("face budget must be positive")
    ratio = F.col("quad_count") * 2 / F.lit(float(face_budget))
    return quad_counts.withColumn("cluster_width", F.greatest(F.lit(1), F.ceil(F.sqrt(ratio)).cast("int")))


def preview_stride(count, budget: int = POINT_BUDGET) -> Column:
    if budget <= 0:
        raise ValueError("point budget must be positive")
    return F.greatest(F.lit(1).cast("long"), F.floor((F.col(count) + (budget - 1)) / budget))


def systematic_sample(rows: DataFrame, budget: int, ordinal: str = "vid", group: str = "model_id") -> DataFrame:
    """Every stride-th row of each group by dense ordinal, at most ``budget`` rows per group."""
    counts = rows.groupBy(group).agg(F.count("*").alias("__n"))
    strides = settle(counts.select(group, preview_stride("__n", budget).alias("__stride")))
    return lookup_join(rows, strides, [group]).where(F.col(ordinal) % F.col("__stride") == 0).drop("__stride")


def model_summary(voxels: DataFrame, resolution_table: DataFrame) -> DataFrame:
    """Counts, attribute histograms and exact bounds of every model in one pass."""
    sized = lookup_join(voxels, resolution_table.select("model_id", "resolution"), ["model_id"])
    positions = {c: dual_position_f32(c, f"d{c}", "resolution") for c in "xyz"}
    return sized.groupBy("model_id").agg(
        F.max("resolution").alias("resolution"),
        F.count("*").alias("voxel_count"),
        (F.count("ovoxel_type") > 0).alias("has_ovoxel_type"),
        case_counts("ovoxel_type").alias("ovoxel_type_counts"),
        (F.count("qef_rank") > 0).alias("has_qef_rank"),
        case_counts("qef_rank").alias("qef_rank_counts"),
        F.array(*[F.min(positions[c]) for c in "xyz"]).alias("bounds_min"),
        F.array(*[F.max(positions[c]) for c in "xyz"]).alias("bounds_max"),
        F.array(*[F.min(c) for c in "xyz"]).alias("grid_min"),
        F.array(*[F.max(c) for c in "xyz"]).alias("grid_max"),
    )


def model_metadata(
    summary: DataFrame, widths: DataFrame, lod_vertices: DataFrame, lod_faces: DataFrame, point_budget: int = POINT_BUDGET
) -> DataFrame:
    """The metadata record of every model: summary, topology counts, preview counts and format versions."""
    vertex_counts = lod_vertices.groupBy("model_id").agg(F.count("*").alias("preview_vertex_count"))
    face_counts = lod_faces.groupBy("model_id").agg(F.count("*").alias("preview_face_count"))
    stride = preview_stride("voxel_count", point_budget)
    counted = summary.join(widths, "model_id", "left")
    for table in (vertex_counts, face_counts):
        counted = counted.join(table, "model_id", "left")
    return (
        counted.withColumn("face_count", F.col("quad_count") * 2)
        .withColumn("preview_voxel_count", F.floor((F.col("voxel_count") + stride - 1) / stride))
        .withColumn("preview_mode", F.lit("vertex-clustered"))
        .withColumn("format_version", F.lit(FORMAT_VERSION))
        .withColumn("store_version", F.lit(STORE_VERSION))
        .fillna(0, ["quad_count", "face_count", "preview_vertex_count", "preview_face_count"])
    )
