"""Volume kinds, roles and orders from file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxspark import constants as C
from voxspark.functions.geometry import _col
from voxspark.functions.labels import _lookup
from voxspark.functions.text import file_name


def volume_kind(name) -> Column:
    """Volume kind of a file name; NULL if the name is not a known volume."""
    stem = F.lower(F.regexp_replace(file_name(name), r"(?i)\.npy$", ""))
    chain = None
    for pattern, kind in C.VOLUME_KIND_PATTERNS:
        chain = F.when(stem.rlike(pattern), kind) if chain is None else chain.when(stem.rlike(pattern), kind)
    return chain


def is_mesh_name(name) -> Column:
    return _col(name).rlike(C.MESH_NAME_PATTERN)


def is_volume_name(name) -> Column:
    return F.lower(_col(name)).endswith(".npy")


def is_manifest_name(name) -> Column:
    return F.lower(_col(name)) == C.MANIFEST_NAME


def _step(name: Column, pattern: str) -> Column:
    return F.regexp_extract(name, pattern, 1).try_cast("int")


def volume_role(name) -> Column:
    """struct<prefix, role> of a step volume; NULL if the name has no role."""
    name = _col(name)
    final = F.lower(F.regexp_extract(name, C.FINAL_CCL_PATTERN, 2))
    inside, boundary = _step(name, C.INSIDE_FILTERED_PATTERN), _step(name, C.SURFACE_BOUNDARY_PATTERN)

    def named(prefix: Column, role: Column) -> Column:
        return F.struct(prefix.alias("prefix"), role.alias("role"))

    def earlier(step: Column, steps: int) -> Column:
        return F.lpad((step - steps).cast("string"), 3, "0")

    role = F.when(final == "labels", F.lit("label")).otherwise(final)
    return (
        F.when(final != "", named(F.regexp_extract(name, C.FINAL_CCL_PATTERN, 1), role))
        .when(inside > 0, named(earlier(inside, 1), F.lit("insideFiltered")))
        .when(boundary > 2, named(earlier(boundary, 2), F.lit("surfaceBoundary")))
    )


def volume_order(name, role) -> Column:
    """Position of a volume among those of its folder; NULL if it is not loadable. ``role`` is that of volume_role."""
    name = _col(name)
    special = _lookup(list(C.SPECIAL_VOLUME_ORDER.items()), F.lower(name))
    offset = _lookup(list(C.ROLE_ORDER_OFFSET.items()), _col(role))
    return F.coalesce(
        special,
        _step(name, C.STANDALONE_PATTERN).cast("double"),
        _step(name, r"^(\d{3})_").cast("double") + offset,
    )


def mesh_order(name) -> Column:
    known = _lookup(list(C.MESH_NAME_ORDER.items()), F.lower(_col(name)))
    return F.coalesce(known, F.lit(len(C.MESH_NAME_ORDER)))
