"""Scans of voxel, volume and mesh files. ``register`` makes the formats vxz, npy, mesh and ply known to a session."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ARCHIVE = "voxspark.zip"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once; Spark distributes the archive."""
    context = spark.sparkContext
    if ARCHIVE not in {os.path.basename(path) for path in context.listFiles}:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="voxspark-package-"), ARCHIVE.removesuffix(".zip"))
        context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))


def register(spark: SparkSession) -> SparkSession:
    from voxspark.sinks.ply import PlyDataSource
    from voxspark.sources.mesh import MeshDataSource
    from voxspark.sources.npy import NpyDataSource
    from voxspark.sources.vxz import VxzDataSource

    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (VxzDataSource, NpyDataSource, MeshDataSource, PlyDataSource):
        spark.dataSource.register(source)
    return spark
