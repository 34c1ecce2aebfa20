"""From listed files to checked voxels, with the files that failed and why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.operators.constraints import STORE_RULES, validate_voxels
from voxspark.operators.ordinals import voxel_ordinals
from voxspark.operators.summary import resolutions
from voxspark.operators.topology import quads
from voxspark.session import settle
from voxspark.sources.vxz import decode, headers_of, read_directory


@dataclass(frozen=True)
class Corpus:
    """Checked models: voxels with vid, resolutions and quads per model, and failures (model_id, reason)."""

    voxels: DataFrame
    resolutions: DataFrame
    quads: DataFrame
    failures: DataFrame


def _requested(headers: DataFrame, resolution: int | None) -> DataFrame | None:
    if resolution is None:
        return None
    if resolution <= 0:
        raise ValueError("resolution must be positive")
    return headers.select("model_id", F.lit(resolution).alias("resolution"))


def _unlisted(files: DataFrame) -> DataFrame:
    """(model_id, reason) of entries that cannot be models: those with a problem, and ids that several files claim."""
    problem = F.min("problem") if "problem" in files.columns else F.lit(None).cast("string")
    claimed = files.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), problem.alias("problem"))
    reason = F.coalesce("problem", F.when(F.col("n") > 1, "duplicate model_id"))
    return claimed.select("model_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def load_corpus(files: DataFrame, resolution: int | None = None, for_store: bool = True) -> Corpus:
    """Decode, number and check every listed file; one bad file does not stop the others.

    ``files`` has model_id and path, and length and problem if known. Every model_id of the list is either among the
    resolutions or among the failures. With ``for_store``, models beyond the 16-bit records of the preview store fail as
    well; exact meshes take all coordinates of 21 bits. Decoded voxels and quads are read several times later on, so each is settled once.
    """
    unlisted = settle(_unlisted(files))
    files = files.join(unlisted, "model_id", "left_anti")
    directory = settle(read_directory(files))
    headers = headers_of(directory)
    decoded = settle(decode(files, directory))
    unreadable = decoded.where(F.col("error").isNotNull()).groupBy("model_id").agg(F.min("error").alias("reason"))
    rows = decoded.where(F.col("error").isNull()).drop("error")
    sizes = settle(resolutions(rows, _requested(headers, resolution)))
    announced = headers.select("model_id", "num_voxel").join(sizes, "model_id", "left")
    violations = validate_voxels(rows, announced).where(F.col("violations") > 0)
    if not for_store:
        violations = violations.where(~F.col("rule").isin(*STORE_RULES))
    broken = violations.groupBy("model_id").agg(F.min("rule").alias("reason"))
    failed = unreadable.unionByName(broken).unionByName(unlisted)
    unusable = settle(failed.groupBy("model_id").agg(F.min("reason").alias("reason")))

    voxels = settle(voxel_ordinals(rows.join(unusable, "model_id", "left_anti")))
    surface = settle(quads(voxels, with_dual=True))
    with_faces = surface.select("model_id").distinct()
    empty = sizes.join(unusable, "model_id", "left_anti").join(with_faces, "model_id", "left_anti")
    failures = settle(unusable.unionByName(empty.select("model_id", F.lit("no quads").alias("reason"))))
    good = sizes.join(failures, "model_id", "left_anti").select("model_id", "resolution", "resolution_source")
    return Corpus(voxels.join(failures, "model_id", "left_anti"), settle(good), surface, failures)
