"""Exact slices of sparse voxel grids: rows, dense rasters, legends and point inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxspark import constants as C
from voxspark.functions.colors import _fixed, channels, voxel_color
from voxspark.functions.geometry import cell_center, check_axis, dual_to_slice, grid_to_pixel, pixel_to_grid
from voxspark.functions.labels import edge_description, fallback_description, rank_deficient, rank_description
from voxspark.operators.lookup import lookup_join
from voxspark.operators.summary import case_counts

VALUES = ("vid", "dx", "dy", "dz", "flags", "ovoxel_type", "qef_rank")


def voxel_slice(voxels: DataFrame, axis: str, index: int) -> DataFrame:
    """Voxels whose coordinate on an axis equals the index; the filter reaches the scan."""
    if index < 0:
        raise ValueError("slice index must not be negative")
    return voxels.where(F.col(check_axis(axis)) == index)


def slice_pixels(rows: DataFrame, resolution_table: DataFrame, axis: str) -> DataFrame:
    """Adds resolution and the pixel px, py of every row of a slice."""
    sized = lookup_join(rows, resolution_table.select("model_id", "resolution"), ["model_id"])
    px, py = grid_to_pixel(check_axis(axis), "x", "y", "z", "resolution")
    return sized.withColumns({"px": px.cast("int"), "py": py.cast("int")})


def slice_raster(pixels: DataFrame, resolution_table: DataFrame, mode="occupancy") -> DataFrame:
    """Every pixel of every model's R x R slice with its colour; missing voxels get the background.

    Only active pixels and one marker per pixel row are shuffled. Each of them then writes itself and the background
    up to the next active pixel, so the dense image is made in place and never joined. A pixel row has at most
    R + 1 entries. If two voxels share a pixel, the last one wins.
    """
    line = F.explode(F.sequence(F.lit(0), F.col("resolution") - 1))
    markers = (
        resolution_table.select("model_id", F.col("resolution").cast("int").alias("resolution"), line.alias("py"))
        .withColumn("px", F.lit(-1))
        .withColumn("color", F.lit(None).cast("int"))
        .withColumn("vid", F.lit(-1).cast("long"))
    )
    active = pixels.select(
        "model_id",
        F.col("resolution").cast("int").alias("resolution"),
        F.col("py"),
        F.col("px"),
        voxel_color(mode).alias("color"),
        F.col("vid").cast("long").alias("vid"),
    )
    order = Window.partitionBy("model_id", "py").orderBy("px", "vid")
    following = F.coalesce(F.lead("px").over(order), F.col("resolution"))
    runs = markers.unionByName(active).withColumn("__next", following)
    filled = runs.where((F.col("__next") > F.col("px")) & (F.col("__next") > 0)).withColumn(
        "__x", F.explode(F.sequence(F.greatest(F.col("px"), F.lit(0)), F.col("__next") - 1))
    )
    is_active = F.col("__x") == F.col("px")
    color = F.when(is_active, F.col("color")).otherwise(_fixed(C.SLICE_BACKGROUND_RGB))
    return filled.select(
        "model_id",
        F.col("__x").alias("px"),
        "py",
        is_active.alias("active"),
        *channels(color),
    )


def slice_legend(rows: DataFrame, resolution_table: DataFrame) -> DataFrame:
    """Active and inactive cells and attribute counts of a slice, per model; empty slices included."""
    counted = rows.groupBy("model_id").agg(
        F.count("*").alias("active"),
        case_counts("ovoxel_type").alias("type_counts"),
        case_counts("qef_rank").alias("rank_counts"),
    )
    zeros = F.array(*[F.lit(0).cast("long")] * 4)
    active = F.coalesce("active", F.lit(0))
    size = F.col("resolution").cast("long")
    return resolution_table.join(counted, "model_id", "left").select(
        "model_id",
        active.cast("long").alias("active"),
        (size * size - active).cast("long").alias("inactive"),
        F.coalesce("type_counts", zeros).alias("type_counts"),
        F.coalesce("rank_counts", zeros).alias("rank_counts"),
    )


def _bracketed(*texts: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *texts), F.lit("]"))


def inspect(probes: DataFrame, voxels: DataFrame, resolution_table: DataFrame) -> DataFrame:
    """Grid cell, world position and voxel record under slice pixels.

    ``probes`` has model_id, axis, idx, px and py. Pixels without a voxel are reported as inactive. Probes that
    pile up on one cell are spread before the join.
    """
    sized = lookup_join(probes, resolution_table.select("model_id", "resolution"), ["model_id"])
    grid = pixel_to_grid("axis", "idx", "px", "py", "resolution")
    located = sized.withColumns({n: c.cast("int") for n, c in zip("xyz", grid)})
    record = voxels.select("model_id", "x", "y", "z", *VALUES)
    found = lookup_join(located, record, ["model_id", "x", "y", "z"], "left")
    active = F.col("vid").isNotNull()
    projected = dual_to_slice("axis", ("x", "y", "z"), ("dx", "dy", "dz"), "resolution")

    def report(column: Column) -> Column:
        return F.coalesce(F.when(active, column), F.lit("-"))

    deficient = F.when(rank_deficient("qef_rank"), "yes").when(~rank_deficient("qef_rank"), "no")
    return found.select(
        *probes.columns,
        "x",
        "y",
        "z",
        *[cell_center(c, "resolution").alias(f"world_{c}") for c in "xyz"],
        active.alias("active"),
        *[F.col(c) for c in ("dx", "dy", "dz")],
        F.when(active, projected["pixel_x"]).alias("dual_px"),
        F.when(active, projected["pixel_y"]).alias("dual_py"),
        report(_bracketed(*[F.col(c).cast("string") for c in ("dx", "dy", "dz")])).alias("dual_text"),
        report(edge_description("flags")).alias("intersections"),
        report(fallback_description("ovoxel_type")).alias("fallback_case"),
        report(rank_description("qef_rank")).alias("rank_text"),
        report(deficient).alias("rank_deficient"),
    )
