"""Continuous preparation of voxel files as they arrive."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxspark.constants import FORMAT_VERSION, STORE_VERSION
from voxspark.functions.text import input_identity
from voxspark.plans.prepare import prepare
from voxspark.session import file_system, settle
from voxspark.sources.files import open_file

BLOCK = 8 * 1024 * 1024
JOBS = "model_id string, status string, reason string, format_version int, store_version int, batch int"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            digest = hashlib.sha256()
            with open_file(path) as handle:
                while block := handle.read(BLOCK):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests)], names=[*batch.schema.names, "digest"])


def content_identities(files: DataFrame, resolution: int | None = None) -> DataFrame:
    """Adds id, the hash of a file's bytes (and resolution). Files are hashed block by block in tasks."""
    columns = files.select("path", "length")
    tasks = files.sparkSession.sparkContext.defaultParallelism * 4
    hashed = columns.repartition(tasks, "path").mapInArrow(_digests, "path string, length long, digest string")
    return hashed.withColumn("id", input_identity("digest", F.lit(resolution).cast("int")))


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The new state of one content from what came in for it: first outcomes of its jobs, then files with it.

    A content that is new or whose last job failed starts a job, with the least path of its files; a file whose content is
    being prepared or ready starts none. Only a few values are held, however many files have one content.
    """
    status = state.get[0] if state.exists else None
    path, length, outcome = None, 0, None
    for part in parts:
        told = part[part["outcome"].notna()]
        if len(told):
            found = max(zip(told["batch"], told["outcome"], strict=True))
            outcome = found if outcome is None else max(outcome, found)
        files = part[part["outcome"].isna()]
        if len(files):
            least = files["path"].min()
            path, length = (least if path is None else min(path, least)), int(files["length"].iloc[0])
    status = status if outcome is None else outcome[1]
    if path is not None:
        starts = status in (None, "failed")
        status = "processing" if starts else status
        yield pd.DataFrame({"id": [key[0]], "path": [path], "length": [length], "status": ["start" if starts else status]})
    state.update((status,))


def job_states(arrivals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What to do about each content that came in: ``start`` a job, or nothing as one is ``processing`` or it is ``ready``.

    ``arrivals`` (id, path, length) and ``outcomes`` (id, outcome, batch) are streams. The state of a content, kept by its
    id in the stream's checkpoint, is processing from the start of a job to its outcome, then ready or failed. A content
    that failed is tried again when a file with it comes in.
    """
    files = arrivals.select("id", "path", "length", F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("long").alias("batch"))
    told = outcomes.select("id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("length"), "outcome", F.col("batch").cast("long"))
    return files.unionByName(told).groupBy("id").applyInPandasWithState(
        _advance, "id string, path string, length long, status string", "status string", "update", GroupStateTimeout.NoTimeout
    )


def prepare_batch(states: DataFrame, store: str, resolution: int | None = None) -> DataFrame:
    """Prepare the contents that start; all others are ``kept``, or ``processing`` if their job has no outcome yet."""
    settled = settle(states)
    starts = settled.where("status = 'start'").select(F.col("id").alias("model_id"), "path", "length")
    others = settled.where("status <> 'start'")
    kept = others.select(F.col("id").alias("model_id"), F.when(F.col("status") == "ready", "kept").otherwise(F.col("status")).alias("status"))
    done = settle(prepare(starts, store, resolution, fresh=True)).unionByName(kept.withColumn("reason", F.lit(None).cast("string")))
    return done.withColumns({"format_version": F.lit(FORMAT_VERSION), "store_version": F.lit(STORE_VERSION)})


def ingest(
    spark: SparkSession, folder: str, store: str, checkpoint: str, resolution: int | None = None, every: str | None = None
) -> StreamingQuery:
    """Watch a folder and prepare each content once, however many files have it and in whichever batches they come.

    Which contents are being prepared, ready or failed is keyed state of the stream: a batch does not ask the store what it
    holds. Outcomes return to the state as a second stream, that of ``jobs`` in the store, to which each batch writes the
    status of its contents, broken ones too; a repeated batch replaces its statuses. Files without a byte are none to Spark's
    file streams and have no status. From a new checkpoint the
    state is built again of the statuses in ``jobs``, as far as they are of the current format. Preparing replaces whole
    models, so a batch that is repeated after a failure gives the same store. ``every`` (as "1 minute") keeps watching at
    that pace; by default the query ends when all files present are prepared.
    """
    arriving = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.vxz")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length")
    )
    system, jobs = file_system(spark, f"{store}/jobs")
    system.mkdirs(jobs)
    told = spark.readStream.schema(JOBS).parquet(f"{store}/jobs")
    current = (F.col("format_version") == FORMAT_VERSION) & (F.col("store_version") == STORE_VERSION)
    outcomes = told.where(F.col("status").isin("ready", "failed") & current).select(F.col("model_id").alias("id"), F.col("status").alias("outcome"), "batch")

    def prepare_one(batch: DataFrame, number: int) -> None:
        prepare_batch(batch, store, resolution).write.mode("overwrite").parquet(f"{store}/jobs/batch={number}")

    states = job_states(content_identities(arriving, resolution), outcomes)
    writer = states.writeStream.outputMode("update").foreachBatch(prepare_one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
