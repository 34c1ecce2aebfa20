"""Freshness, statistics and eviction of cached files, and input identities."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.functions.text import input_identity
from voxspark.sources.files import open_file

READ_BYTES = 8 * 1024 * 1024
_FETCHED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("bytes", pa.int64()), ("reason", pa.string())])


def is_stale(size, cached_size, mtime, cached_mtime) -> Column:
    """A known size or modification time that differs from the cached one."""

    def differs(known: Column, cached: Column) -> Column:
        return known.isNotNull() & ~known.eqNullSafe(cached)

    return differs(F.col(size), F.col(cached_size)) | differs(F.col(mtime), F.col(cached_mtime))


def cache_status(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds status hit, stale or miss to every listed path.

    ``listing`` has path, size and mtime_ms; ``cache`` has one row per path with cached_size and cached_mtime_ms.
    """
    known = cache.select("path", "cached_size", "cached_mtime_ms", F.lit(True).alias("__cached"))
    status = (
        F.when(F.col("__cached").isNull(), "miss")
        .when(is_stale("size", "cached_size", "mtime_ms", "cached_mtime_ms"), "stale")
        .otherwise("hit")
    )
    return listing.join(known, "path", "left").select(*listing.columns, status.alias("status"))


def files_to_fetch(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """Listed files without a valid cached copy."""
    return cache_status(listing, cache).where(F.col("status") != "hit").drop("status")


def _read_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            try:
                with open_file(row["path"]) as handle:
                    row["bytes"] = sum(len(block) for block in iter(lambda: handle.read(READ_BYTES), b""))
                if row["length"] is not None and row["bytes"] != row["length"]:
                    row["reason"] = f"{row['bytes']} bytes instead of {row['length']}"
            except OSError as error:
                row["reason"] = f"{type(error).__name__}: {error}"
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=_FETCHED)


def fetched(files: DataFrame) -> DataFrame:
    """path, length, bytes and reason (NULL if all went well) of every file after reading it whole, block by block in tasks.

    ``files`` has path and length; a file whose size is not the listed one has failed.
    """
    tasks = files.sparkSession.sparkContext.defaultParallelism * 4
    return files.select("path", "length").repartition(tasks, "path").mapInArrow(_read_through, "path string, length long, bytes long, reason string")


def fetch_counts(outcomes: DataFrame) -> DataFrame:
    """Files that were read and files that failed, in one row."""
    return outcomes.agg(F.count_if(F.col("reason").isNull()).alias("succeeded"), F.count_if(F.col("reason").isNotNull()).alias("failed"))


def cache_stats(cache: DataFrame) -> DataFrame:
    """File count, tracked bytes (positive sizes only) and oldest save time."""
    return cache.agg(
        F.count("*").alias("file_count"),
        F.coalesce(F.sum(F.when(F.col("byte_length") > 0, F.col("byte_length"))), F.lit(0)).alias("tracked_bytes"),
        F.min("saved_at").alias("oldest_saved_at"),
    )


def evict_older_than(cache: DataFrame, cutoff_ms: int) -> tuple[DataFrame, DataFrame]:
    """(survivors, outcome): files saved after the cutoff, and count and bytes of those removed."""
    old = F.col("saved_at") <= cutoff_ms
    outcome = cache.where(old).agg(
        F.count("*").alias("deleted_count"), F.coalesce(F.sum("byte_length"), F.lit(0)).alias("deleted_bytes")
    )
    return cache.where(~F.coalesce(old, F.lit(False))), outcome


def identified(inputs: DataFrame) -> DataFrame:
    """Adds id to inputs with content and an optional requested resolution."""
    return inputs.withColumn("id", input_identity(F.sha2(F.col("content").cast("binary"), 256), "resolution"))


def new_inputs(inputs: DataFrame, prepared: DataFrame) -> DataFrame:
    """Each identity once, without those already prepared."""
    return inputs.dropDuplicates(["id"]).join(prepared.select("id"), "id", "left_anti")
