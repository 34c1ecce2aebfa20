"""Prepared stores: exact voxels, an overview sample, a level-of-detail mesh and metadata per model, as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.constants import FORMAT_VERSION, MESH_FACE_BUDGET, POINT_BUDGET, STORE_VERSION
from voxspark.operators.lod import lod_mesh
from voxspark.operators.lookup import lookup_join
from voxspark.operators.summary import cluster_widths, model_metadata, model_summary, systematic_sample
from voxspark.plans.corpus import load_corpus
from voxspark.plans.store import current_version, store_table, write_generation
from voxspark.session import settle

def current_models(spark: SparkSession, store: str, resolution: int | None = None) -> DataFrame | None:
    """Models the store already holds in the current versions (and the requested resolution); None without a store."""
    version = current_version(spark, store)
    if version is None:
        return None
    metadata = store_table(spark, store, "metadata", version)
    current = (F.col("format_version") == FORMAT_VERSION) & (F.col("store_version") == STORE_VERSION)
    if resolution is not None:
        current = current & (F.col("resolution") == resolution)
    return metadata.where(current).select("model_id")


def prepare(
    files: DataFrame,
    store: str,
    resolution: int | None = None,
    point_budget: int = POINT_BUDGET,
    face_budget: int = MESH_FACE_BUDGET,
    fresh: bool = False,
) -> DataFrame:
    """Prepare every listed file the store does not hold yet; returns model_id, status and reason.

    With ``fresh`` the caller knows that the store holds none of them, and the store is not asked.

    All tables of the new models are written as one generation of the store and published by one version file, so readers
    see all of them or none, and a model that is prepared again is never served half new.
    """
    spark = files.sparkSession
    held = None if fresh else current_models(spark, store, resolution)
    known = settle(files.select("model_id").limit(0) if held is None else files.select("model_id").join(held, "model_id", "left_semi"))
    corpus = load_corpus(files.join(known, "model_id", "left_anti"), resolution)

    counts = corpus.quads.groupBy("model_id").agg(F.count("*").alias("quad_count"))
    grid = settle(cluster_widths(counts, face_budget).join(corpus.resolutions, "model_id"))
    vertices, faces = lod_mesh(corpus.voxels, grid, corpus.quads)
    vertices, faces = settle(vertices), settle(faces)
    summary = model_summary(corpus.voxels, corpus.resolutions)
    widths = grid.select("model_id", "quad_count", "cluster_width", "resolution_source")
    names = files.select("model_id", F.substring_index("path", "/", -1).alias("source_name"))
    metadata = model_metadata(summary, widths, vertices, faces, point_budget).join(names, "model_id")

    tables = {
        "voxels": corpus.voxels,
        "voxel_overview": systematic_sample(corpus.voxels, point_budget),
        "lod_vertices": vertices,
        "lod_faces": faces,
        "metadata": metadata,
    }
    if corpus.resolutions.take(1):
        write_generation(spark, store, tables)
    no_reason = F.lit(None).cast("string").alias("reason")
    return (
        corpus.resolutions.select("model_id", F.lit("ready").alias("status"), no_reason)
        .unionByName(known.select("model_id", F.lit("kept").alias("status"), no_reason))
        .unionByName(corpus.failures.select("model_id", F.lit("failed").alias("status"), "reason"))
    )


def stored_slice(spark: SparkSession, store: str, model_id: str, axis: str, index: int) -> DataFrame:
    """Exact voxels of one slice of a prepared model; the index must lie inside its grid."""
    from voxspark.operators.slices import voxel_slice

    version = current_version(spark, store)
    found = None if version is None else store_table(spark, store, "metadata", version, model_id).first()
    if found is None:
        raise ValueError(f"model {model_id!r} is not prepared")
    if not 0 <= index < found.resolution:
        raise ValueError(f"slice index must be in [0, {found.resolution - 1}]")
    return voxel_slice(store_table(spark, store, "voxels", version, model_id), axis, index)


def stored_overview(spark: SparkSession, store: str) -> DataFrame:
    """Overview voxels of all models with their resolution."""
    version = current_version(spark, store)
    sizes = store_table(spark, store, "metadata", version).select("model_id", "resolution")
    return lookup_join(store_table(spark, store, "voxel_overview", version), sizes, ["model_id"])
