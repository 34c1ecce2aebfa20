"""Decode a corpus of voxel files to exact PLY meshes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.functions.geometry import dual_position_f32
from voxspark.operators.lookup import lookup_join
from voxspark.operators.ordinals import dense_ordinals
from voxspark.operators.topology import triangles
from voxspark.plans.corpus import Corpus, load_corpus
from voxspark.sinks.ply import write_ply


def exact_mesh(corpus: Corpus) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces): every voxel is a vertex in file order, faces in order of voxel, axis and half."""
    sizes = corpus.resolutions.select("model_id", "resolution")
    placed = lookup_join(corpus.voxels, sizes, ["model_id"])
    vertices = placed.select(
        F.col("model_id").alias("mesh_id"),
        F.col("vid").alias("vertex_id"),
        *[dual_position_f32(c, f"d{c}", "resolution").alias(c) for c in "xyz"],
    )
    keyed = triangles(lookup_join(corpus.quads, sizes, ["model_id"]))
    faces = dense_ordinals(keyed, "face_key", "face_id")
    return vertices, faces.select(F.col("model_id").alias("mesh_id"), "face_id", "a", "b", "c")


def existing_outputs(files: DataFrame, folder: str) -> DataFrame:
    """model_id of the files whose PLY is already in the folder; only the folder's listing is read."""
    reader = (
        files.sparkSession.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.ply")
    )
    try:
        found = reader.load(folder).select("path")
    except AnalysisException as error:  # a folder that is still to be made holds no output
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return files.select("model_id").limit(0)
    base = folder.removeprefix("file://").rstrip("/") + "/"
    inside = F.regexp_replace("path", r"^file:/+", "/")
    name = F.substring(inside, len(base) + 1, 2**31 - 1)
    outputs = found.select(F.regexp_replace(name, r"\.ply$", "").alias("model_id"))
    return files.select("model_id").join(outputs, "model_id", "left_semi")


def decode_corpus(files: DataFrame, folder: str, resolution: int | None = None, skip_existing: bool = False) -> DataFrame:
    """Write ``<folder>/<model_id>.ply`` for every file and return its status: decoded, skipped or failed."""
    todo, skipped = files, files.select("model_id").limit(0)
    if skip_existing:
        skipped = existing_outputs(files, folder)
        todo = files.join(skipped, "model_id", "left_anti")
    corpus = load_corpus(todo, resolution, for_store=False)
    vertices, faces = exact_mesh(corpus)
    meshes = corpus.resolutions.select(
        F.col("model_id").alias("mesh_id"), F.concat("model_id", F.lit(".vxz")).alias("source"), "resolution"
    )
    write_ply(meshes, vertices, faces, folder)

    done = corpus.resolutions.select("model_id", F.lit("decoded").alias("status"), F.lit(None).cast("string").alias("reason"))
    failed = corpus.failures.select("model_id", F.lit("failed").alias("status"), "reason")
    left_out = skipped.select("model_id", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("reason"))
    return done.unionByName(failed).unionByName(left_out)


def outcome_counts(statuses: DataFrame) -> DataFrame:
    """decoded, skipped, failed and total in one row."""
    named = [F.count_if(F.col("status") == s).alias(s) for s in ("decoded", "skipped", "failed")]
    return statuses.agg(*named, F.count("*").alias("total"))
