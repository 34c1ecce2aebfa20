"""Mixing sources to target weights by temperature.

Source shares of all tokens are raised to an exponent, which is bisected until the weights reach a target entropy and no
source is repeated beyond a limit. The weights become whole token budgets, and a budget becomes passes over the source:
each pass takes the source's blocks in a permuted order, the last one only up to the budget.

Totals, weights and budgets are tables with a row per source, of any number of sources; only sums over them reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxspark.session import settle

#: Documented parameters: documents of a block, exponents that one pass over the totals tries, and such passes.
BLOCK_DOCUMENTS = 1024
TRIED = 31
STEPS = 7
#: Sums over sources are of whole parts of that size, so that they do not depend on the order of rows.
PARTS = 10.0**18
#: Blocks of a source are searched in 2^(60 - RANGE_SHIFT) ranges of their 60-bit draws.
RANGE_SHIFT = 50
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mixture:
    exponent: float
    #: A row per source with a word: source, documents, tokens, weight, budget.
    sources: DataFrame
    #: The whole budget that was dealt: the one asked for, or what the repetition limit allows.
    budget: int


def _sum(value: Column) -> Column:
    """The sum of values of 0 to 1, or a few times that, in PARTS, so that it is the same in any order."""
    return F.sum(F.round(value * PARTS).cast("decimal(20,0)")).cast("double") / PARTS


def _tried(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """Of each exponent: the sum of all raised shares, the entropy of the weights, and the most that a raised share is of its share."""
    raised = shares.select("share", F.explode(F.array(*map(F.lit, exponents))).alias("exponent")).withColumn("raised", F.pow("share", "exponent"))
    found = raised.groupBy("exponent").agg(
        _sum(F.col("raised")).alias("total"), _sum(-F.col("raised") * F.log("share")).alias("logs"), F.max(F.col("raised") / F.col("share")).alias("most")
    )
    rows = sorted(found.collect(), key=lambda row: row["exponent"])
    return [(r["total"], math.log(r["total"]) + r["exponent"] * r["logs"] / r["total"], r["most"]) for r in rows]


def _least_exponent(shares: DataFrame, count: int, budget: int, tokens: int, target_entropy: float, max_passes: float) -> float:
    """The least exponent of 0 to 1 at which both limits hold; both hold at all above, and 1 is taken if they hold at none.

    Each pass over the totals cuts the range in TRIED + 1 parts.
    """

    def holds(tried: tuple[float, float, float]) -> bool:
        total, found, most = tried
        return found <= target_entropy * math.log(count) + 1e-12 and budget * most <= max_passes * tokens * total

    low, high = 0.0, 1.0
    if holds(_tried(shares, [low])[0]):
        return low
    for _ in range(STEPS):
        exponents = [low + (high - low) * i / (TRIED + 1) for i in range(1, TRIED + 1)]
        right = [holds(t) for t in _tried(shares, exponents)]
        first = right.index(True) if True in right else TRIED
        low, high = ([low, *exponents][first], [*exponents, high][first])
    return round(high, 9)


def temperature(totals: DataFrame, budget_share: float, target_entropy: float, max_passes: float) -> Mixture:
    """Weights between the natural shares (exponent 1) and equal ones (0); ``totals`` has source, documents and tokens.

    The exponent is the least one at which the entropy is at most ``target_entropy`` (times the entropy of equal weights)
    and no source gives more than ``max_passes`` times its tokens. The budget is ``budget_share`` of all tokens, rounded
    down. One beyond ``max_passes`` times all tokens can be met by no weights, and is lowered to that. Sources without
    tokens, null ones included, are in no mixture. ``totals`` is read several times.
    """
    used = totals.where("tokens > 0")
    all_of = used.agg(F.count(F.lit(1)).alias("count"), F.sum("tokens").alias("tokens")).first()
    count, tokens = all_of["count"], all_of["tokens"] or 0
    budget = min(math.floor(budget_share * tokens), math.floor(max_passes * tokens))
    shares = used.withColumn("share", F.col("tokens") / F.lit(float(tokens)))
    exponent = _least_exponent(shares, count, budget, tokens, target_entropy, max_passes) if count else 1.0
    total = _tried(shares, [exponent])[0][0] if count else 1.0
    weighed = shares.withColumn("weight", F.pow("share", F.lit(exponent)) / total)
    dealt = F.least(F.floor(F.lit(float(budget)) * F.col("weight")), F.floor(F.lit(float(max_passes)) * F.col("tokens")))
    return Mixture(exponent, weighed.select("source", "documents", "tokens", "weight", dealt.cast("long").alias("budget")), budget)


def _draw(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def with_mixture(df: DataFrame, target_entropy: float, max_passes: float, budget_share: float = 1.0, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, Mixture]:
    """The rows of ``df`` as often as their source's budget takes them, with ``mix_pass``, ``mix_block`` and ``mix_key``.

    (mix_pass, mix_block, mix_key) orders the rows of a source: passes from 0, and in each the blocks and their documents in
    an order of its own. Tokens are words; the whole budget is ``budget_share`` of all of them, rounded down. The last pass
    of a source stops before the first document that would exceed its budget. Null is a source of its own. Sources
    without a word are drawn from never; documents without a word cost nothing. Rows with one doc_id are drawn
    together. An empty table stays empty. Columns named like an output are replaced, all others stay. Tables with a row
    per source are joined as their settled sizes allow: broadcast where they are small, else shuffled. With few sources
    no text is shuffled.
    """
    clean = df.drop("mix_pass", "mix_block", "mix_key")
    name, number = F.col(source).cast("string"), F.regexp_count(text, F.lit(WORD))
    narrow = settle(clean.select(F.col(doc_id).alias("id"), name.alias("source"), F.coalesce(number, F.lit(0)).cast("long").alias("tokens")))
    totals = settle(narrow.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens")))
    mixture = temperature(totals, budget_share, target_entropy, max_passes)
    whole, rest = F.expr("budget DIV tokens"), F.col("budget") % F.col("tokens")
    blocks = F.ceil(F.col("documents") / BLOCK_DOCUMENTS).cast("long")
    plans = settle(mixture.sources.select(F.col("source").alias("p_source"), blocks.alias("blocks"), whole.alias("passes"), rest.alias("rest")))
    keyed = narrow.join(plans.where("rest > 0"), F.col("source").eqNullSafe(F.col("p_source"))).withColumn(
        "block", _block_key(F.col("passes"), F.col("source"), F.col("id"))
    )
    # The block in which the budget ends is the first with which the running sum exceeds it. It is looked for in ranges of
    # blocks first, then in one of them, so that no window holds all blocks of a source.
    sums = settle(keyed.groupBy("p_source", "rest", "block").agg(F.sum("tokens").alias("tokens")))
    ranges = sums.groupBy("p_source", "rest", F.shiftright("block", RANGE_SHIFT).alias("range")).agg(F.sum("tokens").alias("tokens"))
    ended = settle(_ending(ranges, "range").select(F.col("p_source").alias("r_source"), F.col("range").alias("r_range"), "before"))
    near = sums.join(ended, F.col("p_source").eqNullSafe(F.col("r_source")) & (F.shiftright("block", RANGE_SHIFT) == F.col("r_range")))
    last = _ending(near, "block", F.col("before"))
    last = settle(last.select(F.col("p_source").alias("l_source"), F.col("block").alias("last_block"), (F.col("rest") - F.col("before")).alias("room")))
    inside = keyed.join(last, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("block") == F.col("last_block")))
    inside = inside.withColumn("key", _doc_key(F.col("passes"), F.col("id")))
    taken = inside.withColumn("upto", F.sum("tokens").over(Window.partitionBy("l_source").orderBy("key"))).where("upto <= room")
    keys = taken.groupBy(F.col("l_source").alias("k_source")).agg(F.max("key").alias("last_key"))
    cuts = plans.join(last.drop("room"), F.col("p_source").eqNullSafe(F.col("l_source")), "left").join(keys, F.col("p_source").eqNullSafe(F.col("k_source")), "left")
    at = [F.coalesce(c, F.lit(-1).cast("long")).alias(f"_{c}") for c in ("last_block", "last_key")]
    cuts = settle(cuts.select(F.col("p_source").alias("_source"), F.col("blocks").alias("_blocks"), F.col("passes").alias("_passes"), *at))
    drawn = clean.join(cuts, name.eqNullSafe(F.col("_source")))
    block, key = (_block_key(F.col("_passes"), name, F.col(doc_id), F.col("_blocks")), _doc_key(F.col("_passes"), F.col(doc_id)))
    part = (block < F.col("_last_block")) | ((block == F.col("_last_block")) & (key <= F.col("_last_key")))
    times = F.col("_passes") + part.cast("long")
    mixed = drawn.withColumn("_times", times).where("_times > 0").withColumn("mix_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    order = [_block_key(F.col("mix_pass"), name, F.col(doc_id), F.col("_blocks")).alias("mix_block"), _doc_key(F.col("mix_pass"), F.col(doc_id)).alias("mix_key")]
    return mixed.select(*clean.columns, "mix_pass", *order), mixture


def _ending(sums: DataFrame, order: str, start: Column | None = None) -> DataFrame:
    """Per source, the row with which the running sum from ``start`` exceeds ``rest``, and the sum ``before`` it."""
    upto = F.sum("tokens").over(Window.partitionBy("p_source").orderBy(order)) + (F.lit(0) if start is None else start)
    found = sums.withColumn("_upto", upto).withColumn("before", F.col("_upto") - F.col("tokens"))
    least = found.where("_upto > rest AND before <= rest").groupBy("p_source").agg(F.min(F.struct(order, "rest", "before")).alias("_least"))
    return least.select("p_source", "_least.*")


def _block_key(number: Column, source: Column, doc_id: Column, blocks: Column | None = None) -> Column:
    """Where the block of a document comes in a pass; ``blocks`` is the source's number of blocks."""
    return _draw(F.lit("block"), number, source, F.pmod(_draw(doc_id), F.col("blocks") if blocks is None else blocks))


def _doc_key(number: Column, doc_id: Column) -> Column:
    """Where a document comes in its block in a pass."""
    return _draw(F.lit("row"), number, doc_id)
