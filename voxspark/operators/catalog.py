"""File catalogs: listings, and which folder of a tree holds the volumes, meshes and manifest to load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark import constants as C
from voxspark.functions.names import is_manifest_name, is_mesh_name, mesh_order, volume_order, volume_role
from voxspark.operators.lookup import lookup_join
from voxspark.operators.ordinals import sorted_ordinals
from voxspark.session import settle

ROLES = tuple(C.ROLE_SCORE)


def _in_folder() -> tuple[Column, ...]:
    return F.col("type") != "directory", F.lower("name"), F.col("name")


def listing_order(files: DataFrame) -> DataFrame:
    """Directories first, then by lower-cased name."""
    return files.orderBy(*_in_folder())


def listing_ordinals(files: DataFrame) -> DataFrame:
    """Adds ``ordinal``: the place of every entry in its root, folder by folder, each in listing order."""
    return sorted_ordinals(files, (F.col("dir"), *_in_folder()), "ordinal", ["root"])


def _once(column: Column) -> Column:
    """A column of one value a row that later columns read; Spark copies plain expressions into each of its readers."""
    return F.explode(F.array(column))


def classified_files(files: DataFrame) -> DataFrame:
    """Regular files with kind (manifest, mesh, volume), order within the kind, and prefix and role of step volumes.

    Rows are dealt to all cores first: a listing of many files can be a few bytes in one input split, but its names are
    matched with many patterns.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    regular = files.where(F.col("type") == "file").repartition(cores * 2)
    roles = regular.select("*", _once(volume_role("name")).alias("__role"))
    told = F.struct(
        volume_order("name", F.col("__role.role")).alias("order"),
        is_mesh_name("name").alias("mesh"),
        mesh_order("name").cast("double").alias("mesh_order"),
        is_manifest_name("name").alias("manifest"),
    )
    ordered = roles.select("*", _once(told).alias("__told"))
    kind = (
        F.when(F.col("__told.manifest"), "manifest")
        .when(F.col("__told.mesh"), "mesh")
        .when(F.col("__told.order").isNotNull(), "volume")
    )
    position = F.when(F.col("__told.mesh"), F.col("__told.mesh_order")).otherwise(F.col("__told.order"))
    return ordered.select(
        *files.columns, F.col("__role.prefix").alias("prefix"), F.col("__role.role").alias("role"), kind.alias("kind"), position.alias("ord")
    ).where(F.col("kind").isNotNull())


def directory_scores(classified: DataFrame) -> DataFrame:
    """Per root and dir: mesh, volume and non-scalar volume counts, score, and the last manifest."""
    volume = F.col("kind") == "volume"
    scalar = F.lower("name").endswith("999_scalar_field.npy")
    counted = classified.groupBy("root", "dir").agg(
        F.count_if(F.col("kind") == "mesh").alias("meshes"),
        F.count_if(volume).alias("volumes"),
        F.count_if(volume & ~scalar).alias("non_scalar"),
        F.max_by("name", F.when(F.col("kind") == "manifest", F.col("ordinal"))).alias("manifest"),
    )
    mesh_score = F.when(F.col("meshes") > 0, C.DIRECTORY_MESH_SCORE).otherwise(0)
    return counted.withColumn(
        "score", mesh_score + F.col("non_scalar") * C.DIRECTORY_VOLUME_SCORE + F.col("volumes")
    )


def candidates(classified: DataFrame, directories: DataFrame) -> DataFrame:
    """One row per root, dir and prefix: the last file in every role, completeness and score."""
    last = [F.max_by("name", F.when(F.col("role") == role, F.col("ordinal"))).alias(role) for role in ROLES]
    grouped = (
        classified.where(F.col("role").isNotNull())
        .groupBy("root", "dir", "prefix")
        .agg(F.min("ordinal").alias("first_ordinal"), *last)
        .join(directories.select("root", "dir", "meshes"), ["root", "dir"])
    )
    score = F.when(F.col("meshes") > 0, C.CANDIDATE_MESH_SCORE).otherwise(0)
    for role, points in C.ROLE_SCORE.items():
        score = score + F.when(F.col(role).isNotNull(), points).otherwise(0)
    complete = F.col("label").isNotNull() & F.col("components").isNotNull() & F.col("cases").isNotNull()
    return grouped.withColumns({"score": score + F.col("prefix").cast("int"), "complete": complete}).drop("meshes")


def selected_directories(candidate_table: DataFrame, directories: DataFrame) -> DataFrame:
    """The directory of every root: of its best candidate, or else its best scoring directory with volumes.

    Complete candidates come first, then the score; ties go to the candidate seen first, and for directories to the
    first name.
    """
    rank = F.struct(F.col("complete"), F.col("score"), -F.col("first_ordinal"))
    best = candidate_table.groupBy("root").agg(F.max_by("dir", rank).alias("__candidate"))
    by_score = F.struct(-F.col("score"), F.collate("dir", "UNICODE"), F.col("dir"))
    fallback = (
        directories.where(F.col("volumes") > 0).groupBy("root").agg(F.min_by("dir", by_score).alias("__fallback"))
    )
    return fallback.join(best, "root", "left").select("root", F.coalesce("__candidate", "__fallback").alias("dir"))


def roots_without_volumes(files: DataFrame) -> DataFrame:
    """(root, reason) of every root that ``folder_selection`` leaves out: mesh-only ones, and those with neither."""
    kinds = classified_files(files).groupBy("root").agg(
        F.count_if(F.col("kind") == "volume").alias("volumes"), F.count_if(F.col("kind") == "mesh").alias("meshes")
    )
    known = files.select("root").distinct().join(kinds, "root", "left").where(F.coalesce("volumes", F.lit(0)) == 0)
    reason = F.when(F.col("meshes") > 0, "meshes without a loadable volume").otherwise("no loadable volume")
    return known.select("root", reason.alias("reason"))


def folder_selection(files: DataFrame) -> DataFrame:
    """Files to load per root: root, dir, kind, ord, name.

    ``files`` has root, dir, ordinal (position in the listing), name and type. Sort volumes and meshes by ord and
    then by name in Unicode collation. Only the last manifest of a folder counts. Roots that have no loadable volume
    are told by ``roots_without_volumes``.
    """
    classified = settle(classified_files(files))
    directories = settle(directory_scores(classified))
    chosen = settle(selected_directories(candidates(classified, directories), directories))
    loaded = lookup_join(
        classified.where(F.col("kind") != "manifest").select("root", "dir", "kind", "ord", "name"), chosen, ["root", "dir"]
    )
    manifests = (
        directories.join(chosen, ["root", "dir"])
        .where(F.col("manifest").isNotNull())
        .select("root", "dir", F.lit("manifest").alias("kind"), F.lit(None).cast("double").alias("ord"), F.col("manifest").alias("name"))
    )
    return loaded.unionByName(manifests)


def _in_load_order() -> tuple[Column, ...]:
    return F.col("kind") == "mesh", F.col("ord"), F.collate("name", "UNICODE")


def load_order(selection: DataFrame) -> DataFrame:
    """Volumes by step and role, then meshes with the preferred names first, names in Unicode collation."""
    return selection.orderBy("root", *_in_load_order())


def load_ordinals(selection: DataFrame) -> DataFrame:
    """Adds ``place``: where every file stands in the load order of its root and folder."""
    return sorted_ordinals(settle(selection), _in_load_order(), "place", ["root", "dir"])


def default_volumes(selection: DataFrame) -> DataFrame:
    """Per root: the first volume with 'cases' in its name, or else the first volume."""
    other = ~F.lower("name").contains("cases")
    first = F.struct(other.cast("int"), F.col("ord"), F.collate("name", "UNICODE"), F.col("name"))
    return selection.where(F.col("kind") == "volume").groupBy("root").agg(F.min_by("name", first).alias("name"))
