"""Prepared stores: tables in hash buckets, written as generations and published together by one version file.

``<store>/<table>/generation=<g>/bucket=<b>/`` holds the rows of the models of a bucket that were prepared together. A
version is a file in ``<store>/_versions`` that names the generations it consists of; it appears by one rename, after
all its tables are written. Readers hold on to a version, so they never see tables of different versions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.session import file_system

BUCKETS = 64
TABLES = ("voxels", "voxel_overview", "lod_vertices", "lod_faces", "metadata")
#: Order of the rows of a model inside its files, so that scans can skip row groups.
ORDER = {"voxels": ("chunk_no", "chunk_rank"), "voxel_overview": ("vid",), "lod_vertices": ("vertex_id",), "lod_faces": ("face_key",)}


@dataclass(frozen=True)
class Version:
    """A published state: its generations from old to new, whether a newer one replaces models of an older one, and the
    schema of every table."""

    number: int
    generations: tuple[str, ...]
    replacing: bool
    buckets: int
    schemas: Mapping[str, str] = field(default_factory=dict)


def _bucket(model_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(model_id), F.lit(buckets)).cast("int")


def current_version(spark: SparkSession, store: str) -> Version | None:
    """The newest published version, or None without a store."""
    system, folder = file_system(spark, f"{store}/_versions")
    if not system.exists(folder):
        return None
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    numbers = [int(name) for name in names if name.isdigit()]
    if not numbers:
        return None
    text = spark.read.text(f"{store}/_versions/{max(numbers):010d}", wholetext=True).first()["value"]
    told = json.loads(text)
    return Version(max(numbers), tuple(told["generations"]), told["replacing"], told["buckets"], told["schemas"])


def _commit(spark: SparkSession, store: str, version: Version) -> None:
    """Publish a version by renaming its file; a number that is taken means that another writer was faster."""
    system, target = file_system(spark, f"{store}/_versions/{version.number:010d}")
    _, staged = file_system(spark, f"{store}/_versions/.{uuid.uuid4().hex}.tmp")
    told = {"generations": version.generations, "replacing": version.replacing, "buckets": version.buckets, "schemas": dict(version.schemas)}
    out = system.create(staged, False)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    if system.exists(target) or not system.rename(staged, target):
        system.delete(staged, False)
        raise RuntimeError(f"version {version.number} of {store} was published by another writer")


def write_generation(spark: SparkSession, store: str, tables: Mapping[str, DataFrame], replace_all: bool = False, buckets: int = BUCKETS) -> Version:
    """Write the tables of some models as one generation and publish it; all their older rows are replaced with it.

    Every table has model_id. Rows go to hash buckets of models, sorted, by ranges of (bucket, model, order): however many
    models there are, a table gets at most ``buckets`` folders, and a large model is written by many tasks. With
    ``replace_all`` the new generation is all of the store. Until the version is published no reader sees any of it.
    """
    base = current_version(spark, store)
    buckets = buckets if base is None else base.buckets
    number = 1 if base is None else base.number + 1
    generation = f"{number:010d}-{uuid.uuid4().hex[:8]}"
    for name, table in tables.items():
        order = [F.col(c) for c in ("bucket", "model_id", *ORDER.get(name, ()))]
        placed = table.withColumn("bucket", _bucket(F.col("model_id"), buckets)).repartitionByRange(*order).sortWithinPartitions(*order)
        placed.write.mode("error").partitionBy("bucket").parquet(f"{store}/{name}/generation={generation}")
    schemas = {name: _ddl(table) for name, table in tables.items()}
    older = () if base is None or replace_all else base.generations
    replacing = False
    if older:
        written = spark.read.schema(schemas["metadata"]).parquet(f"{store}/metadata/generation={generation}").select("model_id")
        held = store_table(spark, store, "metadata", base).select("model_id")
        replacing = base.replacing or bool(held.join(written, "model_id", "left_semi").take(1))
    version = Version(number, (*older, generation), replacing, buckets, schemas if base is None else {**base.schemas, **schemas})
    _commit(spark, store, version)
    return version


def _ddl(table: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)


def store_table(spark: SparkSession, store: str, name: str, version: Version | None = None, model_id: str | None = None) -> DataFrame:
    """A table of a version (the newest by default). Give one version to read several tables of the same state.

    With ``model_id`` only that model's bucket is read; filters on coordinates skip row groups.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    version = version or current_version(spark, store)
    if version is None:
        raise ValueError(f"no store at {store}")
    paths = [f"{store}/{name}/generation={g}" for g in version.generations]
    schema = f"{version.schemas[name]}, `generation` string, `bucket` int"
    rows = spark.read.schema(schema).option("basePath", f"{store}/{name}").parquet(*paths)
    if model_id is not None:
        rows = rows.where((F.col("bucket") == _bucket(F.lit(model_id), version.buckets)) & (F.col("model_id") == model_id))
    if version.replacing:
        # Generations are named by rising numbers, so the newest of a model is the largest name. The metadata have a row a model.
        held = f"{version.schemas['metadata']}, `generation` string, `bucket` int"
        models = spark.read.schema(held).option("basePath", f"{store}/metadata").parquet(*[f"{store}/metadata/generation={g}" for g in version.generations])
        newest = models.groupBy("model_id").agg(F.max("generation").alias("generation"))
        rows = rows.join(newest, ["model_id", "generation"], "left_semi")
    return rows.drop("generation", "bucket")


def compact(spark: SparkSession, store: str) -> Version:
    """Write all current rows as one generation. Older versions stay readable: no file is deleted."""
    version = current_version(spark, store)
    if version is None:
        raise ValueError(f"no store at {store}")
    return write_generation(spark, store, {name: store_table(spark, store, name, version) for name in version.schemas}, replace_all=True)
