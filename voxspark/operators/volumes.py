"""Slices, histograms and label texts of dense label volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.constants import MAX_SAFE_INTEGER, UNSAFE_LABELS
from voxspark.functions.colors import channels, component_color, label_color
from voxspark.functions.geometry import check_axis, node_position, pixel_to_grid, slice_height
from voxspark.functions.labels import (
    category_color,
    category_label,
    category_order,
    classify_label,
    inspector_label,
    is_finite,
    label_code,
    scalar_side,
    short_phrase,
    truncated,
)
from voxspark.operators.lookup import lookup_join

NODE_AXIS = {"x": "i", "y": "j", "z": "k"}
SHAPE = ("volume_id", "nx", "ny", "nz", "visualization")
LABEL_KEY = ("volume_id", "code")


def volume_slice(cells: DataFrame, axis: str, index: int) -> DataFrame:
    """Cells whose node index on an axis equals the index; the filter reaches the scan."""
    return cells.where(F.col(NODE_AXIS[check_axis(axis)]) == index)


def volume_pixels(cells: DataFrame, volumes: DataFrame, axis: str) -> DataFrame:
    """Pixel position, category and colour of every cell of a volume slice."""
    sized = lookup_join(cells, volumes.select(*SHAPE), ["volume_id"])
    px, up = {"x": ("k", "j"), "y": ("i", "k"), "z": ("i", "j")}[check_axis(axis)]
    return sized.select(
        "volume_id",
        F.col(px).alias("px"),
        (slice_height(axis, "nx", "ny", "nz") - 1 - F.col(up)).alias("py"),
        "value",
        classify_label("value", "visualization").alias("category"),
        label_color("value", "visualization").alias("color"),
    )


def category_histogram(cells: DataFrame, volumes: DataFrame) -> DataFrame:
    """Cells per category, only categories that occur, with their display order, name and colour."""
    sized = lookup_join(cells, volumes.select("volume_id", "visualization"), ["volume_id"])
    category = classify_label("value", "visualization")
    counted = (
        sized.withColumn("category", category)
        .where(F.col("category").isNotNull())
        .groupBy("volume_id", "category")
        .agg(F.count("*").alias("cells"))
    )
    return counted.select(
        "volume_id",
        "category",
        category_order("category").alias("ord"),
        category_label("category").alias("label"),
        category_color("category").alias("color"),
        "cells",
    )


def label_histogram(cells: DataFrame, label_rows: DataFrame) -> DataFrame:
    """Cells per whole label, finite labels only, with colour and short manifest text.

    ``label_rows`` has volume_id, code and text, one row per described label.
    """
    counted = (
        cells.where(is_finite("value"))
        .groupBy("volume_id", truncated("value").alias("label"))
        .agg(F.count("*").alias("cells"))
        .withColumn("code", label_code("label"))
    )
    case = F.concat(F.lit("case "), F.col("code"))
    text = F.coalesce("text", F.concat(F.lit("L-infinity case "), F.col("code")))
    return lookup_join(counted, label_rows, LABEL_KEY, "left").select(
        "volume_id",
        "label",
        "cells",
        *channels(component_color("label")),
        text.alias("text"),
        short_phrase(text, case).alias("phrase"),
    )


def label_texts(cells: DataFrame, label_rows: DataFrame, fallback) -> DataFrame:
    """Adds ``text``: the manifest text of every cell's label, or the fallback."""
    coded = cells.withColumn("code", label_code("value"))
    joined = lookup_join(coded, label_rows, LABEL_KEY, "left")
    return joined.withColumn("text", F.coalesce("text", fallback)).drop("code")


def inspect(probes: DataFrame, cells: DataFrame, volumes: DataFrame, label_rows: DataFrame) -> DataFrame:
    """Node, world position, label text, category and scalar side under volume slice pixels.

    ``probes`` has volume_id, axis, idx, px and py.
    """
    sized = lookup_join(probes, volumes.select(*SHAPE), ["volume_id"])
    node = pixel_to_grid("axis", "idx", "px", "py", slice_height("axis", "nx", "ny", "nz"))
    located = sized.withColumns({n: c.cast("int") for n, c in zip("ijk", node)})
    found = lookup_join(located, cells.select("volume_id", "i", "j", "k", "value"), ["volume_id", "i", "j", "k"], "left")
    found = lookup_join(found.withColumn("code", label_code("value")), label_rows, LABEL_KEY, "left")
    scalar = F.col("visualization") == "scalarField"
    category = classify_label("value", "visualization")
    return found.select(
        *probes.columns,
        "i",
        "j",
        "k",
        *[node_position(n, s).alias(f"world_{a}") for n, s, a in zip("ijk", ("nx", "ny", "nz"), "xyz")],
        "value",
        F.when(~scalar, inspector_label("value", "visualization", "text")).alias("label_text"),
        F.when(scalar, scalar_side("value")).alias("side"),
        F.coalesce(category_label(category), F.lit("-")).alias("category"),
    )


def volume_warnings(cells: DataFrame, volumes: DataFrame) -> DataFrame:
    """(volume_id, warnings) of the volumes that have something to warn of: 64-bit labels that a DOUBLE does not hold exactly."""
    unsafe = unsafe_volumes(cells, volumes).where(F.col("unsafe_labels") > 0)
    return unsafe.select("volume_id", F.array(F.lit(UNSAFE_LABELS)).alias("warnings"))


def unsafe_volumes(cells: DataFrame, volumes: DataFrame) -> DataFrame:
    """64-bit integer volumes with the number of labels beyond the exactly representable range."""
    wide = lookup_join(cells, volumes.where(F.col("dtype").rlike("[iu]8$")).select("volume_id"), ["volume_id"])
    return wide.groupBy("volume_id").agg(F.count_if(F.abs("value") > MAX_SAFE_INTEGER).alias("unsafe_labels"))
