"""Data-quality rules as tables of violations, and completeness of prepared stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.constants import FORMAT_VERSION, MAX_ATTRIBUTE_CASE, STORE_ARTEFACTS, STORE_VERSION, UINT16_MAX
from voxspark.functions.geometry import fits_key, pack_cell
from voxspark.operators.lookup import lookup_join


#: Rules that the preview store adds: its records hold 16-bit coordinates, which exact meshes do not need.
STORE_RULES = ("record_range", "resolution_limit")


def _long_format(counts: DataFrame, rules: dict[str, Column]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(r).alias("rule"), c.cast("long").alias("violations")) for r, c in rules.items()])
    return counts.select("model_id", F.explode(entries).alias("e")).select("model_id", "e.rule", "e.violations")


def duplicate_cells(voxels: DataFrame) -> DataFrame:
    """Cells that more than one voxel claims."""
    return (
        voxels.groupBy("model_id", "x", "y", "z").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
    )


def validate_voxels(voxels: DataFrame, models: DataFrame) -> DataFrame:
    """rule, model_id, violations for every rule and model of either table.

    ``models`` has model_id, resolution and num_voxel (the count the file header announces); a model without any voxel
    counts as 0. Coordinates are first grouped by cell, so both the row rules and the duplicate rule come from one shuffle.
    """

    def outside(column: str) -> Column:
        return F.count_if(F.col(column).isNotNull() & ~F.col(column).between(0, MAX_ATTRIBUTE_CASE))

    cells = voxels.groupBy("model_id", "x", "y", "z").agg(
        F.count("*").alias("n"), outside("ovoxel_type").alias("bad_type"), outside("qef_rank").alias("bad_rank")
    )
    sized = lookup_join(cells, models.select("model_id", "resolution"), ["model_id"], "left")
    top = F.greatest("x", "y", "z")
    low = F.least("x", "y", "z")
    counted = sized.groupBy("model_id").agg(
        F.sum("n").alias("rows"),
        F.sum("bad_type").alias("ovoxel_type_range"),
        F.sum("bad_rank").alias("qef_rank_range"),
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("duplicate_cell"),
        F.sum(F.when(~fits_key("x", "y", "z"), F.col("n")).otherwise(0)).alias("key_range"),
        F.sum(F.when((low < 0) | (top > UINT16_MAX), F.col("n")).otherwise(0)).alias("record_range"),
        F.sum(F.when(top >= F.col("resolution"), F.col("n")).otherwise(0)).alias("beyond_resolution"),
    )
    stated = models.select("model_id", "resolution", F.col("num_voxel").alias("announced"))
    counted = counted.join(stated, "model_id", "full").na.fill(0, [c for c in counted.columns if c != "model_id"])
    rules = {
        "voxel_count": F.when(F.col("announced").isNotNull() & (F.col("rows") != F.col("announced")), 1).otherwise(0),
        "ovoxel_type_range": F.col("ovoxel_type_range"),
        "qef_rank_range": F.col("qef_rank_range"),
        "duplicate_cell": F.col("duplicate_cell"),
        "key_range": F.col("key_range"),
        "record_range": F.col("record_range"),
        "resolution_limit": F.when(F.col("resolution") > UINT16_MAX, 1).otherwise(0),
        "beyond_resolution": F.col("beyond_resolution"),
    }
    return _long_format(counted, rules)


def validate_faces(faces: DataFrame, vertex_counts: DataFrame) -> DataFrame:
    """Triangles with a corner outside the vertex table, and models without any triangle."""
    counted = (
        lookup_join(faces, vertex_counts.select("model_id", "vertex_count"), ["model_id"])
        .groupBy("model_id")
        .agg(
            F.count("*").alias("faces"),
            F.count_if(
                (F.least("a", "b", "c") < 0) | (F.greatest("a", "b", "c") >= F.col("vertex_count"))
            ).alias("outside"),
        )
    )
    every = vertex_counts.select("model_id").join(counted, "model_id", "left")
    return _long_format(
        every,
        {
            "corner_range": F.coalesce("outside", F.lit(0)),
            "no_faces": F.when(F.col("faces").isNull(), 1).otherwise(0),
        },
    )


def require_valid(violations: DataFrame) -> None:
    """Raise if any rule is violated, naming the first few."""
    broken = violations.where(F.col("violations") > 0).limit(5).collect()
    if broken:
        raise ValueError("; ".join(f"{r.model_id}: {r.rule} x{r.violations}" for r in broken))


def complete_stores(artefacts: DataFrame) -> DataFrame:
    """Stores that have every artefact in the current versions: store_id, artefacts, complete.

    Names are matched against the fixed artefact list while aggregating, so no group is collected.
    """
    present = [F.max(F.when(F.col("name") == name, 1).otherwise(0)) for name in STORE_ARTEFACTS]
    found = sum(present[1:], present[0])
    current = (F.max("format_version") == FORMAT_VERSION) & (F.min("format_version") == FORMAT_VERSION)
    current = current & (F.max("store_version") == STORE_VERSION) & (F.min("store_version") == STORE_VERSION)
    return artefacts.groupBy("store_id").agg(
        found.cast("int").alias("artefacts"), ((found == len(STORE_ARTEFACTS)) & current).alias("complete")
    )
