"""Job progress from log lines, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxspark.session import file_system

PREFIX = "PROGRESS "
#: Batches of changes between two full states, and files of a full state.
COMPACT_EVERY = 16
BUCKETS = 16


def progress_events(lines: DataFrame) -> DataFrame:
    """stage, fraction and message of every progress line; other and malformed lines are ignored.

    ``lines`` has job, line_no and line.
    """
    parsed = lines.where(F.col("line").startswith(PREFIX)).select(
        "job", "line_no", F.try_parse_json(F.substring("line", len(PREFIX) + 1, 2**31 - 1)).alias("doc")
    )
    return parsed.where(F.col("doc").isNotNull()).select(
        "job",
        "line_no",
        F.try_variant_get("doc", "$.stage", "string").alias("stage"),
        F.try_variant_get("doc", "$.fraction", "double").alias("fraction"),
        F.try_variant_get("doc", "$.message", "string").alias("message"),
    )


def latest_progress(lines: DataFrame) -> DataFrame:
    """Per job the last stated stage, progress and message; a field that a line leaves out keeps its value."""
    events = progress_events(lines)

    def last(field: str):
        return F.max_by(field, F.when(F.col(field).isNotNull(), F.col("line_no")))

    return events.groupBy("job").agg(
        last("stage").alias("stage"), last("fraction").alias("progress"), last("message").alias("message")
    )


def follow_progress(
    lines: DataFrame, folder: str, checkpoint: str, available_now: bool = False, every: int = COMPACT_EVERY, buckets: int = BUCKETS
) -> StreamingQuery:
    """Keep the latest state of every job in Parquet files below ``folder``; ``progress_of`` reads it.

    Update mode: a batch writes only the jobs that it changed, to a folder of its own that a repeated batch replaces.
    Each ``every`` batches the states of all jobs are written anew, in ``buckets`` files by job, and what is older than
    the writing before that is deleted. So there are two full states and 2 * ``every`` batches of changes at most, and a
    reader has ``every`` batches of time to finish. Nothing is gathered on the driver.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/kind=change/batch={number}")
        if (number + 1) % every == 0:
            _compact(batch.sparkSession, folder, number, buckets)

    writer = latest_progress(lines).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _batches(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Numbers of the batches with a complete folder of a kind, ascending."""
    system, where = file_system(spark, f"{folder}/kind={kind}")
    names = [status.getPath().getName() for status in system.listStatus(where)] if system.exists(where) else []
    numbers = sorted(int(name.removeprefix("batch=")) for name in names if name.startswith("batch="))
    return [n for n in numbers if system.exists(file_system(spark, f"{folder}/kind={kind}/batch={n}/_SUCCESS")[1])]


def _states(spark: SparkSession, folder: str, full: list[int], changes: list[int]) -> DataFrame:
    last = full[-1:]
    paths = [f"{folder}/kind=full/batch={n}" for n in last] + [f"{folder}/kind=change/batch={n}" for n in changes if n > (last or [-1])[0]]
    saved = spark.read.option("basePath", folder).parquet(*paths)
    newest = saved.groupBy("job").agg(F.max_by(F.struct("stage", "progress", "message"), "batch").alias("last"))
    return newest.select("job", "last.*")


def _compact(spark: SparkSession, folder: str, number: int, buckets: int) -> None:
    """Write all states up to a batch as one, unless a repeated batch finds that done, and delete what no reader of the last
    two full states needs."""
    full, changes = _batches(spark, folder, "full"), _batches(spark, folder, "change")
    if number not in full:
        states = _states(spark, folder, [n for n in full if n < number], [n for n in changes if n <= number])
        states.repartition(buckets, "job").write.mode("overwrite").parquet(f"{folder}/kind=full/batch={number}")
    kept = max((n for n in full if n < number), default=-1)
    for kind, old in (("full", [n for n in full if n < kept]), ("change", [n for n in changes if n <= kept])):
        for n in old:
            system, where = file_system(spark, f"{folder}/kind={kind}/batch={n}")
            system.delete(where, True)


def progress_of(spark: SparkSession, folder: str) -> DataFrame:
    """The last saved state of every job: the newest full state and the changes after it."""
    return _states(spark, folder, _batches(spark, folder, "full"), _batches(spark, folder, "change"))
