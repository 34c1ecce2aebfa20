"""Session settings the plans are written for, and where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_SETTLED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

SETTINGS = {
    # Joins whose sides are already clustered on a subset of the join keys need no second shuffle.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()), where


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a local master without one gets a scratch folder."""
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="voxspark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


def settle(df: DataFrame) -> DataFrame:
    """Write a table that is read more than once to the shared checkpoint folder, and read it back from there.

    Later plans start from files with exact sizes instead of recomputing the lineage, also after executors are lost.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/voxspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _SETTLED[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``settle`` returned, once nothing reads them any more; others are left alone."""
    for table in tables:
        path = _SETTLED.pop(table, None)
        if path is not None:
            system, folder = file_system(table.sparkSession, path)
            system.delete(folder, True)
