"""Dense ordinals without a global or per-model single-task window.

A non-negative BIGINT key is read as three 21-bit digits. Ranks are taken digit by digit, so every window
partition holds at most 2^21 rows by construction, however many rows one model has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxspark.constants import COORD_BITS, COORD_MASK
from voxspark.session import settle


def _digit(key: Column, place: int) -> Column:
    return F.shiftright(key, place * COORD_BITS).bitwiseAND(F.lit(COORD_MASK).cast("long"))


def dense_ordinals(keys: DataFrame, key: str, ordinal: str, group: Sequence[str] = ("model_id",)) -> DataFrame:
    """Add the 0-based rank of a unique non-negative key within each group.

    Rows are ranked inside their (group, high, middle digits) first and settled, so that the input runs once; the highest
    ranks are the sizes of the blocks, whose offsets are joined to the settled rows. The offsets are settled too: their
    size is known before that join is planned, and the rows are not shuffled for a table that is small.
    """
    group = list(group)
    block = [*group, "__hi", "__mid"]
    local = Window.partitionBy(*block).orderBy(key)
    numbered = keys.withColumn("__hi", _digit(F.col(key), 2)).withColumn("__mid", _digit(F.col(key), 1))
    ranked = settle(numbered.withColumn("__rank", F.row_number().over(local)))

    rows = ranked.groupBy(*block).agg(F.max("__rank").cast("long").alias("__n"))
    before = (Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy("__hi").rowsBetween(*before)
    blocks = rows.groupBy(*group, "__hi").agg(F.sum("__n").alias("__n"))
    blocks = blocks.select(*group, "__hi", F.coalesce(F.sum("__n").over(outer), F.lit(0)).alias("__block_start"))
    inside = Window.partitionBy(*group, "__hi").orderBy("__mid").rowsBetween(*before)
    starts = settle(
        rows.withColumn("__row_start", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
        .join(blocks, [*group, "__hi"])
        .select(*block, (F.col("__block_start") + F.col("__row_start")).alias("__start"))
    )
    return (
        ranked.join(starts, block)
        .withColumn(ordinal, (F.col("__start") + F.col("__rank") - 1).cast("long"))
        .drop("__hi", "__mid", "__rank", "__start")
    )


def sorted_ordinals(rows: DataFrame, order: Sequence[Column], ordinal: str, group: Sequence[str]) -> DataFrame:
    """Add the 0-based place of every row in its group's order; the order may be of any type, collations included.

    Rows are dealt by ranges of (group, order) and numbered by their places in the sorted tasks, so a group of any size
    is spread over tasks, and rows that are equal in the whole order keep places of their own. The offsets are one row
    per (task, group): a window partition has at most as many rows as there are tasks.
    """
    group = list(group)
    tie = F.monotonically_increasing_id()
    keys = [*[F.col(c) for c in group], *order, F.col("__tie")]
    placed = settle(
        rows.withColumn("__tie", tie)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("__tie")
        .withColumn("__position", F.monotonically_increasing_id())
        .withColumn("__task", F.shiftright("__position", 33).cast("int"))
    )
    renamed = [F.col(c).alias(f"__of_{c}") for c in group]
    runs = placed.groupBy(F.col("__task").alias("__run"), *renamed).agg(F.count(F.lit(1)).alias("__rows"), F.min("__position").alias("__first"))
    before = Window.partitionBy(*[f"__of_{c}" for c in group]).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("__start", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    matched = [F.col("__task") == F.col("__run"), *[F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in group]]
    place = (F.col("__position") - F.col("__first") + F.col("__start")).cast("long").alias(ordinal)
    return placed.join(starts, matched).select(*rows.columns, place)


def voxel_ordinals(voxels: DataFrame, ordinal: str = "vid") -> DataFrame:
    """File-order ordinal of every voxel: start of its chunk plus its rank in the chunk.

    The chunk table of a model is at most as long as the chunk directory in its file header.
    """
    chunks = voxels.groupBy("model_id", "chunk_no").agg(F.count("*").alias("__n"))
    order = Window.partitionBy("model_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.select(
        "model_id", "chunk_no", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__start")
    )
    return (
        voxels.join(starts, ["model_id", "chunk_no"])
        .withColumn(ordinal, (F.col("__start") + F.col("chunk_rank")).cast("long"))
        .drop("__start")
    )
