"""Sharding by jump consistent hashing: a key's shard follows from the key and the number of shards alone.

Adding a shard moves only the rows that the new shard takes; there is no ring table. Everything is column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxspark.session import settle

#: Fixed values of the published algorithm: multiplier of the 64-bit congruential generator, and its 31-bit range.
MULTIPLIER_HIGH, MULTIPLIER_LOW = 0x27BB2EE6, 0x87B0B0FD
RANGE = float(1 << 31)
#: Folds of the first round. A key jumps about ln(shards) times; keys that need more go through a round over all shards.
FIRST_ROUND = 64


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) 32-bit halves of key * multiplier + 1 modulo 2^64, in products that stay below 2^63."""
    mask32, mask16 = F.lit(0xFFFFFFFF), F.lit(0xFFFF)

    def halves(value: Column) -> tuple[Column, Column]:
        return F.shiftright(value, 16), value.bitwiseAND(mask16)

    low_high, low_low = halves(low)
    high_high, high_low = halves(high)
    upper = low_high * MULTIPLIER_LOW
    total = low_low * MULTIPLIER_LOW + F.shiftleft(upper.bitwiseAND(mask16), 16) + 1
    carry = F.shiftright(total, 32) + F.shiftright(upper, 16)
    cross = high_low * MULTIPLIER_LOW + F.shiftleft((high_high * MULTIPLIER_LOW).bitwiseAND(mask16), 16)
    return (carry + cross + low * MULTIPLIER_HIGH).bitwiseAND(mask32), total.bitwiseAND(mask32)


def _jumps(state: Column, shards: int, rounds: int) -> Column:
    def jump(s: Column, _: Column) -> Column:
        high, low = _next(s["high"], s["low"])
        draw = F.shiftright(high, 1) + 1
        moved = F.struct(
            high.alias("high"),
            low.alias("low"),
            s["next"].alias("shard"),
            F.floor((s["next"] + 1).cast("double") * (F.lit(RANGE) / draw.cast("double"))).alias("next"),
        )
        return F.when(s["next"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, jump)


def key_hash(key: Column) -> Column:
    """The first 64 bits of the MD5 of the key as text, as (high, low) halves; a null key hashes as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))

    def part(start: int) -> Column:
        return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")

    return F.struct(part(1).alias("high"), part(9).alias("low"))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a key of any type."""
    hashed = key_hash(key)
    start = F.struct(
        hashed["high"].alias("high"), hashed["low"].alias("low"), F.lit(-1).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("next")
    )
    first = _jumps(start, shards, min(FIRST_ROUND, shards))
    if shards > FIRST_ROUND:
        first = F.when(first["next"] < shards, _jumps(first, shards, shards)["shard"]).otherwise(first["shard"])
        return first.cast("int")
    return first["shard"].cast("int")


def assign_shards(df: DataFrame, key: str, shards: int, order: str | None = None) -> DataFrame:
    """Adds ``shard``, ``grown_shard`` (with one shard more) and ``slot`` (gapless from 0 in each shard, in ``order``).

    Rows are dealt by ranges of (shard, order, position in the input), so a shard or a repeated key of any size is split
    over tasks. The slots come from positions inside the tasks and one offset per (task, shard): that table has at most
    tasks + shards rows. Repeated rows and null keys keep a slot each; an empty table stays empty. Input columns named
    like an output are replaced.
    """
    order = order or key
    rows = (
        df.drop("shard", "grown_shard", "slot")
        .withColumn("shard", jump_shard(F.col(key), shards))
        .withColumn("grown_shard", jump_shard(F.col(key), shards + 1))
        .withColumn("_tie", F.monotonically_increasing_id())
    )
    keys = ("shard", order, "_tie")
    placed = settle(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_tie")
        .withColumn("_position", F.monotonically_increasing_id())
        .withColumn("_task", F.shiftright("_position", 33).cast("int"))
    )
    runs = placed.groupBy("_task", "shard").agg(F.count(F.lit(1)).alias("_rows"), F.min("_position").alias("_first"))
    before = Window.partitionBy("shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("_task", "shard", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), ["_task", "shard"])
        .withColumn("slot", F.col("_position") - F.col("_first") + F.col("_offset"))
        .select(*[c for c in df.columns if c not in ("shard", "grown_shard", "slot")], "shard", "grown_shard", "slot")
    )
